"""Line dedup by site-relative frequency, in DataFrame functions only.

A line of a host's pages is boilerplate if it stands in at least ``min_pages``
of them and in more than the share ``max_ratio`` of all; its occurrences go.
Lines are the text between newlines, compared without blanks, tabs and
carriage returns at their ends; blank lines always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import own_names
from larder.session import materialize

MAX_RATIO = 0.1
MIN_PAGES = 5
#: Parts into which the lines of one host, and the occurrences of one line, are dealt in joins.
SALT = 32
_ENDS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_ENDS))


def _line_key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text",
                max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, line, pages, host_pages)``: the boilerplate lines, ``line`` by the MD5 of its bare text.

    Every row is a page of its host, also with NULL text; NULL hosts form a host of their own.
    """
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    bare = F.array_distinct(F.transform(_lines(F.col("text")), _bare))
    seen = (pages.select("host", F.explode(bare).alias("l")).where("l <> ''")
            .select("host", _line_key(F.col("l")).alias("line"))
            .groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages))
    left = seen.withColumn("s", F.pmod(F.xxhash64("line"), F.lit(SALT)))
    right = total.select(F.col("host").alias("of"), "host_pages", _salts().alias("s2"))
    near = left.join(right, left.host.eqNullSafe(right["of"]) & (left.s == right.s2))
    return (near.where(F.col("pages") / F.col("host_pages") > max_ratio)
            .select("host", "line", "pages", "host_pages"))


def clean(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
          max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the boilerplate lines gone from ``text``, and the columns ``counts`` after its own.

    Every row stays, a text of boilerplate only as the empty text; NULL texts stay
    NULL with 0 lines, the empty text has one (blank) line; equal rows get equal
    results; no rows give no rows. Columns of ``docs`` named as ``counts``
    give way to the operator's; all others stay as they are.
    """
    known = materialize(boilerplate(docs, host_col, text_col, max_ratio, min_pages), "line-dedup")
    own = [docs[id_col].alias("i"), F.xxhash64(docs[text_col]).alias("th"), docs[host_col].alias("h")]
    lines = (docs.select(*own, F.posexplode(_lines(docs[text_col])).alias("pos", "l"))
             .select("i", "th", "h", "pos", _bare(F.col("l")).alias("l")).where("l <> ''")
             .select("i", "th", "h", "pos", _line_key(F.col("l")).alias("key"),
                     F.pmod(F.xxhash64("i", "th"), F.lit(SALT)).alias("s")))
    bad = known.select("host", "line", _salts().alias("s2"))
    hit = lines.join(bad, lines.h.eqNullSafe(bad.host) & (lines.key == bad.line) & (lines.s == bad.s2))
    gone, i, th, h = own_names(docs, "_drop", "_i", "_th", "_h")
    drop = (hit.groupBy("i", "th", "h").agg(F.collect_set("pos").alias(gone))
            .select(F.col("i").alias(i), F.col("th").alias(th), F.col("h").alias(h), gone))
    joined = docs.join(drop, docs[id_col].eqNullSafe(drop[i]) & (F.xxhash64(docs[text_col]) == drop[th])
                       & docs[host_col].eqNullSafe(drop[h]), "left")
    text = docs[text_col]
    every = _lines(text)
    # the split text is bound once, as x.e, for all its lines
    kept = F.transform(F.array(F.struct(every.alias("e"), F.col(gone).alias("d"))), lambda x: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["e"]) - 1), x["d"]), lambda i: F.element_at(x["e"], i + 1)), "\n"))[0]
    out = [F.when(F.col(gone).isNull(), text).otherwise(kept).alias(c) if c == text_col else docs[c]
           for c in docs.columns if c not in counts]
    return joined.select(*out, F.when(text.isNull(), 0).otherwise(F.size(every)).cast("long").alias(counts[0]),
                         F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(counts[1]))


def oracle(table: str = "documents", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> str:
    """DuckDB text of the query's result over ``table`` (unique ids)."""
    return f"""
        with lines as (
          select doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) as bare from (
            select doc_id, source, unnest(string_split(text, chr(10))) as line,
                   unnest(range(len(string_split(text, chr(10))))) as pos
            from {table} where text is not null)),
        total as (select source, count(*) as n from {table} group by source),
        bad as (
          select l.source, l.bare from (
            select source, bare, count(distinct doc_id) as pages from lines where bare <> '' group by source, bare) l
          join total t on t.source is not distinct from l.source
          where l.pages >= {min_pages} and l.pages / t.n > {max_ratio}),
        marked as (
          select l.*, exists (select 1 from bad b where b.source is not distinct from l.source and b.bare = l.bare) as gone
          from lines l),
        kept as (
          select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text,
                 count(*) as n_lines, count(*) filter (where gone) as n_dropped
          from marked group by doc_id)
        select d.doc_id, k.text, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_dropped, 0) as n_dropped
        from {table} d left join kept k on k.doc_id = d.doc_id"""
