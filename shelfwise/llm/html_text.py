"""Main text of web pages by a style tree of each host.

The DOMs of a host's pages are merged: elements of one path (tags, classes, ids) are one element node of the tree. Its
presentation importance is the entropy of its children's sequences over the pages, its content importance one minus the
mean entropy of its texts over the pages; both are composed up the tree. Of each page the branches go whose importance,
weighted by what their tags and names say, is low. Too small a host takes the importance that the path has on all hosts.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import materialise

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe template svg".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HEAD = set("html head title meta link base style script noscript template".split())
#: Elements that a start tag of the same group closes, up to the nearest of the containers.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES |= {k: ("thead tbody tfoot tr td th", "table") for k in ("thead", "tbody", "tfoot")}

#: Tags, roles and parts of class and id names that mark presentation, reader comments and main text.
LOW_TAGS = set("head nav footer aside form header menu button select dialog script style title textarea noscript iframe template svg object canvas".split())
LOW_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
LOW_NAMES = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer copyright sidebar aside widget widgets cookie cookies consent gdpr notice notices notification banner "
    "popup modal overlay newsletter subscribe subscription signup login ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted share sharing "
    "social related recommended recommendations comment comments commentlist disqus respond replies search searchform form pagination pager toolbar skip".split()
)
COMMENT_NAMES = set("comment comments commentlist disqus respond replies".split())
MAIN_NAMES = set("article content main post entry story articlebody".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

#: A branch goes if its weight times its importance is at most this.
LOW = 0.5
#: Weights: named as presentation, or outside the main text; of no known kind; of a named kind within the main text.
#: Plain elements within the main text, and those around it, are not judged.
OUTSIDE, UNKNOWN, WITHIN = 0.5, 1.0, 5.0
#: Distinct pages from which a path's importance counts; damping of presentation in composed importance.
LEAST_PAGES, DAMPING = 8, 0.9
#: Element nodes (some 150 bytes each in a task) up to which the tree goes to every task; a larger one is joined.
BROADCAST_NODES = 200_000


class Page:
    """A page's elements (parents before children) and pieces of text (block, element, text, inside a link)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.role, self.key = [-1], ["#root"], [[]], [""], ["#root"]
        self.pieces: list[tuple[int, int, str, bool]] = []
        self._block = 0
        self._build(source)
        self._weigh()

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        found = {}
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append([p.lower() for n in names for p in PART.findall(n)])
        self.role.append(found.get("role", "").lower() or ("article" if found.get("itemprop", "").lower() == "articlebody" else ""))
        self.key.append(" ".join([tag, *sorted(found.get("class", "").split()), "#" + re.sub(r"\d+", "0", found.get("id", ""))]))
        return len(self.tag) - 1

    def _build(self, source: str) -> None:
        stack, links, at = [0], 0, 0  # elements that are open, of them links

        def close_to(k: int) -> None:
            nonlocal links
            links -= sum(self.tag[i] == "a" for i in stack[k:])
            del stack[k:]

        def say(text: str) -> None:
            if text:
                self.pieces.append((self._block, stack[-1], html.unescape(text) if "&" in text else text, links > 0))

        while m := TOKEN.search(source, at):
            say(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                k = next((k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == tag or tag in INLINE and self.tag[stack[k]] not in INLINE), 0)
                if k and self.tag[stack[k]] == tag:
                    close_to(k)
                if tag not in INLINE:
                    self._block += 1
                continue
            if tag == "br":
                say(" ")
                continue
            if tag not in INLINE:
                self._block += 1
                self._close_implied(tag, stack, close_to)
            if tag in VOID:
                continue
            i = self._open(stack[-1], tag, m[3])
            stack.append(i)
            links += tag == "a"
            if tag in RAW:  # its content is no markup and no text
                end = RAW_END[tag].search(source, at)
                at = end.start() if end else len(source)
        say(source[at:])

    def _close_implied(self, tag: str, stack: list[int], close_to) -> None:
        if tag not in HEAD and any(self.tag[i] == "head" for i in stack):
            close_to(next(k for k, i in enumerate(stack) if self.tag[i] == "head"))
        # a block ends an open paragraph that only inline elements have followed
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == "p":
                close_to(k)
                break
            if self.tag[stack[k]] not in INLINE:
                break
        if tag in CLOSES:
            closed, within = (x.split() for x in CLOSES[tag])
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in within:
                    break
                if self.tag[stack[k]] in closed:
                    close_to(k)
                    # go on: a row closes its cells and then the row before
                    continue

    def _weigh(self) -> None:
        """weight of each element (None: not judged); text beside the main text gets an element of its own."""
        n = len(self.tag)
        named = [bool(LOW_NAMES.intersection(x)) for x in self.names]
        low = [t in LOW_TAGS or named[i] or self.role[i] in LOW_ROLES for i, t in enumerate(self.tag)]
        reader = [bool(COMMENT_NAMES.intersection(x)) for x in self.names]
        low[0] = False
        for i in range(n):
            if self.tag[i] in ("html", "body"):
                low[i] = False
        kind = [0 if t == "article" or self.role[i] == "article" else 1 if t == "main" or self.role[i] == "main" else 2 if MAIN_NAMES.intersection(self.names[i]) and t not in INLINE else 3 for i, t in enumerate(self.tag)]
        # a header of the main text itself is no site header
        inside = [False] * n
        for i in range(1, n):
            p = self.parent[i]
            inside[i] = inside[p] or kind[p] < 2 and not low[p]
            if inside[i] and low[i] and (self.tag[i] == "header" or self.tag[i] not in LOW_TAGS and LOW_NAMES.intersection(self.names[i]) <= {"header"}):
                low[i] = False
        text = [0] * n
        link = [0] * n
        for _, i, t, linked in self.pieces:
            size = len(t) - t.count(" ")
            text[i] += size
            link[i] += size if linked else 0
        for i in range(n - 1, 0, -1):
            text[self.parent[i]] += text[i]
            link[self.parent[i]] += link[i]

        def regions() -> list[int]:
            under = [False] * n
            for i in range(1, n):
                under[i] = under[self.parent[i]] or low[i]
            for level in range(3):
                held = [False] * n
                found = []
                for i in range(1, n):
                    held[i] = held[self.parent[i]]
                    if kind[i] == level and not under[i] and not held[i] and text[i]:
                        held[i] = True
                        found.append(i)
                if found:
                    return found
            return []

        main = regions()
        if not main:
            # a frame that is named as presentation, but holds all of the main text
            for i in range(1, n):
                if kind[i] < 2 and text[i] and not low[i]:
                    p, path = self.parent[i], []
                    while p > 0:
                        path.append(p)
                        p = self.parent[p]
                    if not any(reader[p] for p in path):
                        for p in path:
                            low[p] = False
            main = regions()
        within, around = [False] * n, [not main] * n
        for i in main:
            within[i] = True
            p = self.parent[i]
            while p >= 0:
                around[p] = True
                p = self.parent[p]
        self.weight: list[float | None] = [None] * n
        gone = [False] * n
        for i in range(1, n):
            p = self.parent[i]
            within[i] = within[i] or within[p]
            plain = self.key[i] == f"{self.tag[i]} #"
            if low[i] or gone[p]:
                self.weight[i] = OUTSIDE
            elif main:
                self.weight[i] = None if within[i] and (plain or i in main) or around[i] else WITHIN if within[i] else OUTSIDE
            elif self.tag[i] not in ("html", "body"):
                listed = self.tag[i] not in ("p", "h1", "h2", "h3") and self.tag[i] not in INLINE and text[i] and link[i] > 0.8 * text[i]
                self.weight[i] = OUTSIDE if listed else UNKNOWN
            gone[i] = self.weight[i] == OUTSIDE
        if main:
            beside: dict[int, int] = {}
            for k, (block, i, t, linked) in enumerate(self.pieces):
                if not within[i] and around[i]:
                    if i not in beside:
                        beside[i] = self._open(i, "#text", "")
                        self.weight.append(OUTSIDE)
                    self.pieces[k] = (block, beside[i], t, linked)

    def paths(self) -> list[int]:
        """A hash of each element's path from the root, as a signed 64-bit integer."""
        out = [0]
        for i in range(1, len(self.tag)):
            out.append(xxhash.xxh64_intdigest(self.key[i].encode("utf-8", "surrogatepass"), out[self.parent[i]] & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
        return out

    def judged(self) -> dict[int, float]:
        """The weight of each path that is judged; the greatest where elements of one path differ."""
        out: dict[int, float] = {}
        for p, w in zip(self.paths(), self.weight):
            if w is not None:
                out[p] = max(w, out.get(p, 0.0))
        return out

    def text(self, removed: set[int]) -> str:
        """The text without the removed paths' branches; if they hold all of it, only named presentation goes."""
        paths = self.paths()

        def without(is_gone) -> str:
            gone, blocks = [False] * len(self.tag), {}
            for i in range(1, len(self.tag)):
                gone[i] = gone[self.parent[i]] or is_gone(i)
            for block, i, t, _ in self.pieces:
                if not gone[i]:
                    blocks.setdefault(block, []).append(t)
            return " ".join(filter(None, (" ".join("".join(t).split()) for t in blocks.values())))

        judged = without(lambda i: self.weight[i] is not None and paths[i] in removed)
        return judged or without(lambda i: self.weight[i] == OUTSIDE)

    def facts(self) -> tuple[int, list[int], list[dict], list[dict], list[dict]]:
        """Digest of the text, chains of the text-bearing elements, their texts' hashes, child sequences, weights."""
        paths, texts, children = self.paths(), {}, {}
        for _, i, t, _ in self.pieces:
            if t.strip():
                texts.setdefault(i, []).append(" ".join(t.split()))
        for i in range(1, len(self.tag)):
            children.setdefault(self.parent[i], []).append(self.key[i])
        hashed = lambda parts: xxhash.xxh64_intdigest("\n".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
        leaves, chains = {}, {}
        for i, parts in texts.items():
            chain, p = [], i
            while p > 0:
                chain.append(paths[p])
                p = self.parent[p]
            chains[paths[i]] = chain
            leaves[paths[i], hashed(parts)] = None
        styles = {(paths[i], hashed(children.get(i, []))): None for i in range(1, len(self.tag))}
        digest = hashed(sorted(x for i, parts in texts.items() if self.weight[i] != OUTSIDE for x in parts))
        return (
            digest,
            [{"path": p, "chain": c} for p, c in chains.items()],
            [{"path": p, "feature": f} for p, f in leaves],
            [{"path": p, "style": s} for p, s in styles],
            [{"path": p, "weight": w} for p, w in self.judged().items()],
        )


FACTS = (
    "k1 long, k2 long, host string, digest long, chains array<struct<path:long,chain:array<long>>>, leaves array<struct<path:long,feature:long>>, "
    "styles array<struct<path:long,style:long>>, weights array<struct<path:long,weight:double>>"
)


def _facts(pages: DataFrame) -> DataFrame:
    """What the tree needs of each page; written, without texts."""

    def run(batches):
        listed = lambda **kinds: pa.list_(pa.struct(kinds))
        number, real = pa.int64(), pa.float64()
        kinds = (number, listed(path=number, chain=pa.list_(number)), listed(path=number, feature=number), listed(path=number, style=number), listed(path=number, weight=real))
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                b = whole.slice(start, 200)
                facts = list(zip(*(Page(x or "").facts() for x in b.column("html").to_pylist())))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k1", "k2", "host")), *[pa.array(x, kind) for x, kind in zip(facts, kinds)]], ["k1", "k2", "host", "digest", "chains", "leaves", "styles", "weights"])

    return materialise(pages.select("k1", "k2", "host", "html").mapInArrow(run, FACTS), "page-facts")


def style_tree(facts: DataFrame) -> DataFrame:
    """host (null: all hosts), path, pages, importance of every element node.

    Pages of one host with the same texts count once, so that copies are no template. Counts are aggregated in each
    task and then by host, path and text, so a host may be of any size.
    """
    slim = facts.select("host", "digest", "chains", "leaves", "styles").dropDuplicates(["host", "digest"])
    both = slim.withColumn("host", F.explode(F.array("host", F.lit(None).cast("string"))))
    of = lambda column: both.select("host", F.explode(column).alias("x")).select("host", "x.*")
    ln = lambda c: F.log(c.cast("double"))

    # a text that c of m pages have in equal parts has an entropy over the pages of ln c / ln m
    c = of("leaves").groupBy("host", "path", "feature").agg(F.count("*").alias("c"))
    content = c.groupBy("host", "path").agg(F.count("*").alias("d"), F.sum(ln(F.col("c"))).alias("h"))
    pages = of("chains").groupBy("host", "path").agg(F.count("*").alias("m"), F.first("chain").alias("chain"))
    leaf = _null_safe(pages, content).withColumn("content", F.when(F.col("m") > 1, 1 - F.col("h") / (F.col("d") * ln(F.col("m")))).otherwise(1.0))
    below = leaf.select("host", F.explode("chain").alias("path"), "m", "content")
    below = below.groupBy("host", "path").agg((F.sum(F.col("content") * F.col("m")) / F.sum("m")).alias("content"))

    s = of("styles").groupBy("host", "path", "style").agg(F.count("*").alias("c"))
    shown = s.groupBy("host", "path").agg(F.sum("c").alias("pages"), F.count("*").alias("l"), F.sum(F.col("c") * ln(F.col("c"))).alias("h"))
    total = F.col("pages").cast("double")
    shown = shown.withColumn("presentation", F.when(F.col("pages") > 1, 1 - F.col("h") / (total * ln(total))).otherwise(1.0))
    damp = F.pow(F.lit(DAMPING), F.col("l"))
    tree = _null_safe(shown, below).withColumn("importance", (1 - damp) * F.col("presentation") + damp * F.coalesce("content", F.lit(0.0)))
    return tree.select("host", "path", "pages", "importance")


def _null_safe(left: DataFrame, right: DataFrame) -> DataFrame:
    """left join on host, which may be null, and path."""
    r = right.withColumnsRenamed({"host": "_host", "path": "_path"})
    return left.join(r.hint("merge"), left["host"].eqNullSafe(r["_host"]) & (left["path"] == r["_path"]), "left").drop("_host", "_path")


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Blocks come in page order, joined by one space, with character references decoded and white space inside a block
    as one space; nothing else of the main text is dropped. Null and empty pages have an empty text. Rows that repeat an
    id, or have none, are pages like others; copies get the same text; a page without a host is of the host ''. An
    empty table gives none; other columns are not read. A very long page is the work of one task.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    # two hashes tell pages apart; rows that agree in all are alike in their texts too
    keyed = rows.withColumns({"k1": F.xxhash64("page_id", "url", "html"), "k2": F.xxhash64(F.lit(2), "html", "url", "page_id")})
    facts = _facts(keyed)
    tree = materialise(style_tree(facts), "style-tree").filter(F.col("pages") >= LEAST_PAGES)
    kind = lambda c: keyed.schema[c].dataType.simpleString()
    schema = f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars long"

    def texts(batches, removed_of):
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                b = whole.slice(start, 200)
                found = []
                for source, given in zip(b.column("html").to_pylist(), b.column(3).to_pylist()):
                    page = Page(source or "")
                    found.append(page.text(removed_of(page, given)))
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if tree.count() <= BROADCAST_NODES:
        importance = pages.sparkSession.sparkContext.broadcast({(r["host"], r["path"]): r["importance"] for r in tree.collect()})

        def low_of(page, site):
            own = importance.value
            return {p for p, w in page.judged().items() if w * own.get((site, p), own.get((None, p), 1.0)) <= LOW}

        return keyed.select("page_id", "url", "html", "host").mapInArrow(lambda batches: texts(batches, low_of), schema)

    own = tree.filter(F.col("host").isNotNull()).select("host", "path", F.col("importance").alias("own"))
    every = tree.filter(F.col("host").isNull()).select("path", F.col("importance").alias("every"))
    judged = facts.select("k1", "k2", "host", F.explode("weights").alias("x")).select("k1", "k2", "host", "x.*")
    judged = judged.join(own.hint("merge"), ["host", "path"], "left").join(every.hint("merge"), "path", "left")
    low = judged.filter(F.col("weight") * F.coalesce("own", "every", F.lit(1.0)) <= LOW)
    removed = low.groupBy("k1", "k2").agg(F.collect_set("path").alias("removed"))
    joined = keyed.join(removed.hint("merge"), ["k1", "k2"], "left").select("page_id", "url", "html", "removed")
    return joined.mapInArrow(lambda batches: texts(batches, lambda page, gone: set(gone or ())), schema)
