"""PDF files as tables: their objects, page trees, page counts and page texts.

A file is read once, into rows of its objects; from then on a page, a font or a
stream is a row, and references are joins: the page tree is walked level by
level, contents and character maps are joined to their pages, and the texts of
pages are read in as many tasks as there are pages. Protected files (RC4) are
opened by the empty password, else by the given one.

A file that can't be read (no trailer, a damaged stream on one of its pages, AES,
a password that is missing or wrong) has no pages in `page_texts`, and counts as
one page in `page_counts`. Nodes that lead back to themselves are walked once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .pdf_syntax import File, Ref, font_codes, shown_text, unicode_map
from .shared import bounded_batches, written

OBJECTS = "path string, number int, kind string, kids array<int>, contents array<int>, fonts map<string,int>, codes map<int,string>, characters int, stream binary"
_ARROW = pa.schema(
    [("path", pa.string()), ("number", pa.int32()), ("kind", pa.string()), ("kids", pa.list_(pa.int32())), ("contents", pa.list_(pa.int32())), ("fonts", pa.map_(pa.string(), pa.int32())), ("codes", pa.map_(pa.int32(), pa.string())), ("characters", pa.int32()), ("stream", pa.binary())]
)


def _refs(item: object) -> list[int]:
    return [x.number for x in (item if isinstance(item, list) else [item]) if isinstance(x, Ref)]


def _rows(path: str, content: bytes, password: str | None, whole: bool = True) -> list[dict]:
    """The objects of a file that its pages need; its tree alone, if not `whole`."""
    file = File(content)
    if file.state(password).startswith("password"):
        return [{"path": path, "number": 0, "kind": "locked"}]
    file.unpack()
    catalog = file.get(file.trailer["Root"])
    pages = catalog.get("Pages") if isinstance(catalog, dict) else None
    if not isinstance(file.get(pages), dict):
        raise ValueError("no page tree")
    rows, streams, fonts, made = [{"path": path, "number": 0, "kind": "root", "kids": _refs(pages)}], set(), {}, 0
    for number, item in file.objects.items():
        if not isinstance(item, dict) or not (item.get("Type") in ("Pages", "Page") or "Kids" in item):
            continue
        row = {"path": path, "number": number, "kind": "Pages" if "Kids" in item else "Page"}
        resources = file.get(item.get("Resources")) if whole else None
        if isinstance(resources, dict):
            named = file.get(resources.get("Font")) or {}
            row["fonts"] = {}
            for name, font in named.items():
                if isinstance(font, Ref):
                    at = font.number
                else:
                    made, at = made - 1, made - 1
                row["fonts"][name], fonts[at] = at, file.get(font)
        if row["kind"] == "Pages":
            row["kids"] = _refs(file.get(item["Kids"]))
        else:
            contents = item.get("Contents")
            row["contents"] = _refs(file.get(contents)) if isinstance(file.get(contents), list) else _refs(contents)
            streams |= set(row["contents"]) if whole else set()
        rows.append(row)
    for number, font in fonts.items():
        if isinstance(font, dict):
            characters = next(iter(_refs(font.get("ToUnicode"))), None)
            streams |= {characters} - {None}
            rows.append({"path": path, "number": number, "kind": "Font", "characters": characters, "codes": {} if font.get("Subtype") == "Type0" else font_codes(font, file.get)})
    for number in streams:
        try:
            rows.append({"path": path, "number": number, "kind": "stream", "stream": file.stream(number)})
        except Exception:  # damaged data: the page that needs it can't be read
            rows.append({"path": path, "number": number, "kind": "damaged"})
    return rows


def objects(files: DataFrame, password: Column | None = None, whole: bool = True) -> DataFrame:
    """Rows of OBJECTS for files (path, content); a file that can't be read has one row, of kind broken or locked. Not `whole`: without streams and fonts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, word in zip(*(c for c in batch.columns), strict=True):
                try:
                    rows = _rows(path.as_py(), content.as_py() or b"", word.as_py(), whole)
                except Exception:  # whatever is wrong with a file, it has no pages
                    rows = [{"path": path.as_py(), "number": 0, "kind": "broken"}]
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    word = F.lit(None).cast("string") if password is None else password.cast("string")
    return bounded_batches(files).select("path", "content", word.alias("password")).mapInArrow(run, OBJECTS)


def _shuffled(table: DataFrame) -> DataFrame:
    """`table`, never sent whole through the driver to a join: files of objects pack so well that Spark takes large ones for small."""
    return table.hint("merge")


def leaves(found: DataFrame) -> DataFrame:
    """path, page (from 1), contents and fonts of the pages of each file, in the order of its tree.

    One join for each level of the deepest tree; a node that is on the way to itself ends there.
    """
    nodes = found.where(F.col("kind").isin("Pages", "Page")).select("path", "number", "kind", "kids", "contents", "fonts")
    start = found.where("kind = 'root'").select("path", F.posexplode("kids").alias("pos", "number"))
    level = start.select("path", "number", F.array("pos").alias("place"), F.array().cast("array<int>").alias("seen"), F.lit(None).cast("map<string,int>").alias("above"))
    done = []
    while True:
        here = written(level.join(_shuffled(nodes), ["path", "number"]).withColumn("fonts", F.coalesce("fonts", "above")), "pdf-level")
        done.append(here.where("kind = 'Page'").select("path", "place", "contents", "fonts"))
        inner = here.where(F.col("kind") == "Pages").select("path", "place", F.concat("seen", F.array("number")).alias("seen"), F.col("fonts").alias("above"), F.posexplode("kids").alias("pos", "number"))
        inner = inner.where(~F.array_contains("seen", F.col("number")))
        if inner.isEmpty():
            break
        level = inner.select("path", "number", F.concat("place", F.array("pos")).alias("place"), "seen", "above")
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every.select("path", F.row_number().over(Window.partitionBy("path").orderBy("place")).alias("page"), "contents", "fonts")


def page_counts(files: DataFrame, password: Column | None = None) -> DataFrame:
    """path and the number of its pages; 1 for a file that can't be read."""
    found = written(objects(files, password, whole=False), "pdf-objects")
    counted = leaves(found).groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("n"))
    unread = F.max(F.col("kind").isin("broken", "locked"))
    return found.groupBy("path").agg(unread.alias("unread")).join(_shuffled(counted), "path", "left").select("path", F.when(F.col("unread"), 1).otherwise(F.coalesce("n", F.lit(0))).alias("pages"))


def page_texts(files: DataFrame, password: Column | None = None) -> DataFrame:
    """path, page (from 1) and text of every page of every file that can be read; a page without contents has an empty text."""
    found = written(objects(files, password), "pdf-objects")
    every = written(leaves(found), "pdf-pages")
    streams = found.where(F.col("kind").isin("stream", "damaged")).select("path", F.col("number").alias("of"), "kind", "stream")
    parts = every.select("path", "page", F.posexplode("contents").alias("pos", "of")).join(_shuffled(streams), ["path", "of"], "left")
    contents = parts.groupBy("path", "page").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("stream", F.lit(b"")).alias("stream")))).alias("parts"), F.max(F.coalesce(F.col("kind") == "damaged", F.lit(False))).alias("damaged"))
    fonts = found.where("kind = 'Font'").select("path", F.col("number").alias("font"), "codes", F.col("characters").alias("of"))
    fonts = fonts.join(_shuffled(streams), ["path", "of"], "left").select("path", "font", "codes", F.col("stream").alias("characters"))
    used = every.select("path", "page", F.explode("fonts").alias("name", "font")).join(_shuffled(fonts), ["path", "font"])
    used = used.groupBy("path", "page").agg(F.collect_list(F.struct("name", "codes", "characters")).alias("fonts"))
    whole = every.select("path", "page").join(_shuffled(contents), ["path", "page"], "left").join(_shuffled(used), ["path", "page"], "left")
    broken = whole.where("damaged").select("path").distinct()
    streams_of = F.transform("parts", lambda p: p["stream"])
    return whole.join(_shuffled(broken), "path", "left_anti").select("path", "page", _shown(streams_of, F.col("fonts")).alias("text"))


@F.pandas_udf(StringType())
def _shown(contents: pd.Series, fonts: pd.Series) -> pd.Series:
    known: dict[bytes, tuple[dict[int, str], int]] = {}  # maps of characters are shared by the pages of a batch

    def font(f: dict) -> tuple[dict[int, str], int]:
        if f["characters"] is None:
            return dict(f["codes"] or {}), 1
        if f["characters"] not in known:
            known[f["characters"]] = unicode_map(f["characters"])
        codes, width = known[f["characters"]]
        return dict(f["codes"] or {}) | codes, width

    def text(parts, of) -> str:
        names = {f["name"]: font(f) for f in (of if of is not None else [])}
        return shown_text(b"\n".join(parts if parts is not None else []), names)

    return pd.Series([text(p, f) for p, f in zip(contents, fonts, strict=True)])


@F.pandas_udf(StringType())
def _state(contents: pd.Series, passwords: pd.Series) -> pd.Series:
    def one(content: bytes | None, password: str | None) -> str:
        try:
            file = File(content or b"")
            state = file.state(password)
            if state != "open":
                return state
            file.unpack()
            catalog = file.get(file.trailer["Root"])
            return "open" if isinstance(catalog, dict) and isinstance(file.get(catalog.get("Pages")), dict) else "unreadable"
        except Exception:  # it is not opened, whatever the reason
            return "unreadable"

    return pd.Series([one(c, p) for c, p in zip(contents, passwords, strict=True)])


def file_state(content: Column, password: Column | None = None) -> Column:
    """open, opened, password_required, password_wrong or unreadable (which goes on as it is)."""
    return _state(content, F.lit(None).cast("string") if password is None else password)
