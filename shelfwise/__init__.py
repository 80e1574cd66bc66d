"""Shelfwise: retail catalog and scan analytics on PySpark."""
