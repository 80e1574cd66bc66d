"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions near its hits, embedded checksums."""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import bound_batches

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"

# Keywords and patterns of the rule set, and public token formats.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ["assign", "access", "hex", "checked"]


def checksum62(body: str) -> str:
    """The six base-62 digits of a body's crc32 that end a checked token."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in ((0, ASSIGN_WORDS), (1, ["akia"]), (3, CHECKED_WORDS)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def scan(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each secret, in code points, sorted."""
    found = []
    # a lower-cased byte stands for each byte, so that places stay; ASCII texts need no mapping
    plain = text.isascii()
    low = text.lower() if plain else text.encode("utf-8", "surrogatepass").lower().decode("latin-1")
    end = [0, 0, 0, 0]
    points = seen = 0
    for last, (kind, length) in automaton.iter(low):
        at = last - length + 1
        if not plain:
            points += sum(1 for c in low[seen:at] if not "\x80" <= c < "\xc0") if at - seen < 64 else len(low[seen:at].encode("latin-1").decode("utf-8", "surrogatepass"))
            seen, at = at, points
        if at < end[kind]:
            continue
        m = (ASSIGN, ACCESS, None, CHECKED)[kind].match(text, at)
        if not m:
            continue
        if kind == 3 and checksum62(m[1]) != m[2]:
            continue
        end[kind] = m.end()
        if kind == 0 and m.end(1) - m.start(1) < 6 or kind == 1 and m.end() - at < 20:
            continue
        found.append((at, kind, m.end()))
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans (kind:start:end, code points) of every row of docs, sorted by start, then kind.

    Base kinds are assign, access and hex; kind checked adds tokens whose embedded checksum holds. Matches of a
    kind do not overlap. A null or empty text has none; rows that repeat an id are scanned each; an empty table gives
    none; other columns are not read. A very long text is the work of one task, at linear cost.
    """

    bound_batches(docs.sparkSession)

    def run(batches):
        a = _automaton()
        for b in batches:
            rows = [scan(t or "", a) for t in b.column("text").to_pylist()]
            base = [[x for x in r if x[1] < 3] for r in rows]
            text = lambda r: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in r)
            count = lambda k: pa.array([sum(x[1] == k for x in r) for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()), count(0), count(1), count(2),
                    pa.array([hashlib.sha256(text(r).encode()).hexdigest() for r in base], pa.string()),
                    pa.array([text(r) for r in rows], pa.string()), count(3),
                ],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
