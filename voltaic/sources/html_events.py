"""Outage events extracted from raw HTML pages.

Runs as an Arrow-batched ``mapInArrow`` over a distributed ``pages`` table;
each page is parsed with the standard-library HTML parser (the pages are not
well-formed XML, so ``xpath`` cannot be used). The per-page parser is a small
helper; the distribution, typing and downstream cleaning are Spark's. Batches
are small and turned into Python objects a few pages at a time, so a worker's
memory does not grow with its partition.
"""

from __future__ import annotations

import sys
from html.parser import HTMLParser

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.constants import EVENT_CELL_CLASSES, EVENT_ROW_CLASS
from voltaic.functions.columns import parse_mw
from voltaic.session import small_batches

PAGES_AT_ONCE = 1000  # pages in an Arrow batch

# The parser runs in Python workers, which need not have this package installed: ship this
# module's code with the task (by value) instead of importing it there by name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENT_SCHEMA = ("page_id long, event_id string, unit_name string, affected_area string, event_type string, "
                "start_date string, end_date string, unavailable_mw string, description string, "
                "source_url string")


class _RowParser(HTMLParser):
    """Collects ``tr.event-row`` rows: first text of each classed cell, plus data-event-id."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self._row: dict | None = None
        self._cell: str | None = None
        self._depth = 0  # tags open inside the cell

    def _close_row(self):
        if self._row is not None:
            self.rows.append(self._row)
        self._row = self._cell = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "tr":  # an open row ends where the next one begins
            self._close_row()
            if EVENT_ROW_CLASS in classes:
                self._row = {"_data_id": a.get("data-event-id") or ""}
        elif tag in ("td", "th") and self._row is not None:
            hit = [c for c in classes if c in EVENT_CELL_CLASSES] if tag == "td" else []
            self._cell, self._depth = (hit[0] if hit else None), 0
        elif self._cell is not None and tag not in ("br", "img", "input", "hr", "wbr"):
            self._depth += 1

    def handle_data(self, data):
        if self._cell is not None and not self._depth:
            self._row.setdefault(EVENT_CELL_CLASSES[self._cell], data)  # the cell's first own text

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._cell = None
        elif tag in ("tr", "table", "tbody"):
            self._close_row()
        elif self._cell is not None and self._depth:
            self._depth -= 1

    def close(self):
        super().close()
        self._close_row()


def parse_event_rows(html: str) -> list[dict]:
    p = _RowParser()
    p.feed(html or "")
    p.close()
    out = []
    for r in p.rows:
        ev = {k: (r.get(k) or "").strip() for k in EVENT_CELL_CLASSES.values()}
        if not ev["event_id"]:
            ev["event_id"] = r["_data_id"]
        if ev["event_id"]:
            if "unavailable_mw" not in r:
                ev["unavailable_mw"] = "0"
            out.append(ev)
    return out


def _extract(batches, at_once: int = 50):
    """Event rows of Arrow batches of pages (id, html, url); no more than ``at_once`` pages are Python objects at a time."""
    import pyarrow as pa
    fields = list(EVENT_CELL_CLASSES.values())
    schema = pa.schema([("page_id", pa.int64()), *((f, pa.string()) for f in fields), ("source_url", pa.string())])
    for batch in batches:
        for part in (batch.slice(i, at_once) for i in range(0, batch.num_rows, at_once)):
            ids = part.column(0).cast(pa.int64()).to_pylist()
            recs = [{"page_id": pid, **ev, "source_url": url}
                    for pid, html, url in zip(ids, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                    for ev in parse_event_rows(html)]
            yield pa.RecordBatch.from_pylist(recs, schema)


def extract_events_html(pages: DataFrame, html_col: str = "html", url_col: str = "url",
                        id_col: str = "page_id", scraped_at: str | None = None) -> DataFrame:
    """Every event row of every page, MW parsed (P10), provenance url and scrape time."""
    # only pages that name the row class can hold a row: the others never reach Python
    small_batches(pages.sparkSession, PAGES_AT_ONCE)
    raw = pages.select(id_col, html_col, url_col).where(F.contains(F.col(html_col), F.lit(EVENT_ROW_CLASS))).mapInArrow(
        _extract, EVENT_SCHEMA)
    ts = F.current_timestamp() if scraped_at is None else F.lit(scraped_at).cast("timestamp")
    return raw.withColumn("unavailable_mw", parse_mw("unavailable_mw")).withColumn("scraped_at", ts)
