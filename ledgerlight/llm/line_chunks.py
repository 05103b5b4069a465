"""Line dedup by content-defined chunks of lines, in DataFrame operations only.

A rolling hash over the hashes of the last WINDOW lines decides after which lines a chunk ends, so an inserted line moves
only the boundaries next to it. A line of LONG_WORDS words or more is a chunk of its own. A chunk counts as a passage if
it has two lines that hold words and MIN_WORDS words, or LONG_WORDS words. Of passages that occur more than once in all
texts the first occurrence (smallest doc_id, then position) stays, and later ones that equal it byte for byte go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.llm.storage import stored

WINDOW = 2
DIVISOR = 3          # a chunk ends after one line in DIVISOR
BASE, MODULUS = 31, 1_000_003
MIN_WORDS = 10
LONG_WORDS = 50
ROW = "_line_chunk_row"
MARKS = "_line_chunk_marks"


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def words(line: Column) -> Column:
    """Blanks plus one; 0 for a blank line."""
    return F.when(F.trim(line) == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def chunked(rows: DataFrame) -> DataFrame:
    """`rows` with a column text get `lines` and `spans`: (first line, lines, is a passage) of each chunk."""
    at = F.col
    lines = rows.withColumn("lines", F.split("text", "\n"))
    facts = lines.withColumn("hashes", F.transform("lines", line_hash)).withColumn("words", F.transform("lines", words))

    def ends(i: Column) -> Column:
        rolled = sum((F.get("hashes", i - back) * BASE ** back for back in range(1, WINDOW)), F.get("hashes", i))
        return ((F.coalesce(rolled, F.lit(1)) % MODULUS % DIVISOR == 0) | (F.get("words", i) >= LONG_WORDS)
                | (F.coalesce(F.get("words", i + 1), F.lit(LONG_WORDS)) >= LONG_WORDS))

    cut = facts.withColumn("ends", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), ends))

    def span(end: Column, k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get("ends", k - 1) + 1)
        own = F.slice(at("words"), start + 1, end - start + 1)
        total = F.aggregate(own, F.lit(0), lambda a, x: a + x)
        passage = (total >= LONG_WORDS) | ((total >= MIN_WORDS) & (F.size(F.filter(own, lambda x: x > 0)) >= 2))
        return F.struct(start.alias("start"), (end - start + 1).alias("n"), passage.alias("passage"))

    return cut.withColumn("spans", F.transform("ends", span)).drop("hashes", "words", "ends")


def piece(span: Column) -> Column:
    return F.array_join(F.slice(F.col("lines"), span["start"] + 1, span["n"]), "\n")


def passages(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, row, k, passage) of each passage of (doc_id, row, text)."""
    # the outer form: for the plain one the optimizer would filter by size(spans) > 0 first, which computes the chunks twice
    each = chunked(docs).select("doc_id", "row", "lines", F.posexplode_outer("spans").alias("k", "span")).where("span.passage")
    text = each.select("doc_id", "row", "k", piece(F.col("span")).alias("passage"))
    return text.select(F.xxhash64("passage").alias("h1"), F.xxhash64("passage", F.lit(1)).alias("h2"), "doc_id", "row", "k", "passage")


def drop_repeated_chunks(docs: DataFrame, count: str = "removed_chunks") -> DataFrame:
    """`docs` (doc_id, text, any other columns) with repeated passages cut from text, and their number as last column `count`.

    Every row stays. Null and empty texts stay as they are; a text whose chunks all go becomes empty. Rows that repeat
    doc_id and text count as one document and are cut alike; rows that share only the doc_id are told apart by the text.
    A null doc_id comes first in the order. An own column `count` is replaced.
    """
    keyed = docs.drop(count).withColumn(ROW, F.xxhash64("text"))
    found = passages(keyed.where("text is not null").select("doc_id", F.col(ROW).alias("row"), "text"))
    place = F.struct("doc_id", "row", "k")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    copies = stored(found.join(repeated.drop("last"), ["h1", "h2"]), "passages").withColumn("is_first", place == F.col("first"))
    kept = copies.where("is_first").select("h1", "h2", F.col("passage").alias("kept")).distinct()
    gone = copies.where("not is_first").join(kept, ["h1", "h2"]).where("passage = kept")
    marks = gone.groupBy("doc_id", "row").agg(F.collect_set("k").alias(MARKS)).select(
        F.col("doc_id").alias("_line_chunk_doc"), F.col("row").alias("_line_chunk_of"), MARKS)
    cut = keyed.join(marks, (F.col("doc_id").eqNullSafe(F.col("_line_chunk_doc"))) & (F.col(ROW) == F.col("_line_chunk_of")), "left")
    rest = chunked(cut.select("text", MARKS, *[F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(docs.drop(count).columns)])
                   .withColumn("text", F.when(F.col(MARKS).isNotNull(), F.col("text"))))
    left = F.filter(F.col("spans"), lambda s, k: ~F.array_contains(F.col(MARKS), k))
    text = F.array_join(F.transform(left, piece), "\n")
    names = docs.drop(count).columns
    return rest.select(*[F.when(F.col(MARKS).isNotNull(), text).otherwise(F.col(f"_own_{i}")).alias(c) if c == "text" else F.col(f"_own_{i}").alias(c)
                         for i, c in enumerate(names)], F.coalesce(F.size(MARKS), F.lit(0)).alias(count))


def comparison_sql(source: str = "documents") -> str:
    """(doc_id, text, removed_chunks) in DuckDB's dialect, for tables whose doc_id is unique and not null."""
    rolled = " + ".join(["h", *(f"lag(h, {back}) over doc * {BASE ** back}" for back in range(1, WINDOW))])
    return f"""
with own as (select doc_id, text, string_split(text, chr(10)) as lines from {source} where text is not null),
lines as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from own),
facts as (select *, ('0x' || substr(md5(line), 1, 7))::bigint as h,
          case when trim(line, ' ') = '' then 0 else length(line) - length(replace(line, ' ', '')) + 1 end as w from lines),
marked as (select *, coalesce(({rolled}) % {MODULUS} % {DIVISOR} = 0, false) or w >= {LONG_WORDS}
           or coalesce(lead(w) over doc, {LONG_WORDS}) >= {LONG_WORDS} as ends
           from facts window doc as (partition by doc_id order by i)),
numbered as (select *, coalesce(sum(ends::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as k
             from marked),
chunks as (select doc_id, k, string_agg(line, chr(10) order by i) as chunk, sum(w) as w, count(*) filter (where w > 0) as n
           from numbered group by doc_id, k),
placed as (select *, w >= {LONG_WORDS} or (w >= {MIN_WORDS} and n >= 2) as passage,
           row_number() over (partition by chunk order by doc_id, k) as turn from chunks),
rest as (select doc_id, coalesce(string_agg(chunk, chr(10) order by k) filter (where not (passage and turn > 1)), '') as text,
         count(*) filter (where passage and turn > 1) as removed_chunks from placed group by doc_id)
select d.doc_id, coalesce(rest.text, d.text) as text, coalesce(removed_chunks, 0)::int as removed_chunks
from {source} d left join rest using (doc_id)"""
