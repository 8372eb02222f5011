"""Benchmark decontamination with a distributed positional inverted index.

Words: A-Z lowered, then runs of characters that are neither ASCII signs, space nor control. A
benchmark item gives the phrases of ``size`` consecutive words (an item of fewer words is one
phrase). The index holds, for each term, where it stands: (term, key, pos), sorted by term; only
terms that some phrase needs are stored. A phrase starts from the list of its rarest term: each
posting, moved back by the term's offset, is a possible start. The next rarer terms' lists, moved
likewise, are intersected with these starts by an equi-join on (key, term, position), so no list is
multiplied by another. What is left is compared with the text itself.

Only DataFrame and SQL functions. Terms' counts decide what is rare and cover all documents.

Defined cases. Null or empty text: no words, never hit. Items without words give no phrase; null
item_id: phrases match and hit words, but the item is not counted or named. Repeated items and
rows: items count once, rows each get their result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlife.llm.storage import Workspace, row_key, small

# Fixed value of the contract, before A-Z are lowered: what stands between words. Splitting there
# takes time in proportion to the text; extracting each match would copy the text once a word.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST = 500_000  # rows; more are joined by shuffle


def raw_words(text: str = "text") -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def fold(word: Column) -> Column:
    """A-Z lowered and nothing else; ``lower`` does just that where all is ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(text: str = "text") -> Column:
    return F.transform(raw_words(text), fold)


def tokens(docs: DataFrame) -> DataFrame:
    """(key, pos, term) of every word of ``docs(key, text)``."""
    return docs.select("key", F.posexplode(raw_words()).alias("pos", "raw")).select("key", "pos", fold(F.col("raw")).alias("term"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, salts: int = 8) -> DataFrame:
    """Postings (term, key, pos), all of a term's together but for ``salts`` ways to split a frequent one."""
    found = tokens(docs)
    if terms is not None:
        found = found.join(small(terms, BROADCAST), "term", "left_semi")
    return found.repartition("term", F.pmod("key", F.lit(salts))).sortWithinPartitions("term", "key", "pos")


def phrases_of(space: Workspace, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct phrases (pid, words, n), and (pid, item_id)."""
    listed = items.select(F.col("item_id"), words().alias("w")).where("size(w) > 0")
    cut = listed.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {size}, 0)), i -> slice(w, i + 1, {size}))")).alias("words")).distinct()
    phrases = space.save(cut.select("words").distinct().select(F.monotonically_increasing_id().alias("pid"), "words", F.size("words").alias("n")), "phrases")
    return phrases, space.save(cut.join(phrases, "words").select("pid", "item_id"), "phrase-items")


def probes_of(phrases: DataFrame, frequency: DataFrame, lists: int) -> DataFrame:
    """(pid, term, offset, rank): the ``lists`` rarest places of each phrase whose words all occur. At most n rows stand in a window."""
    placed = phrases.select("pid", "n", F.posexplode("words").alias("offset", "term")).join(frequency, "term")
    by = Window.partitionBy("pid")
    ranked = placed.withColumn("known", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy("count", "offset")))
    return ranked.where((F.col("known") == F.col("n")) & (F.col("rank") <= lists)).select("pid", "term", "offset", "rank")


def intersect(probes: DataFrame, index: DataFrame, lists: int) -> DataFrame:
    """(pid, key, start) where the first ``lists`` terms of a phrase stand at their offsets."""
    first = small(probes.where("rank = 1").select("pid", "term", "offset"), BROADCAST)
    starts = index.join(first, "term").select("pid", "key", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    for rank in range(2, lists + 1):
        step = probes.where(F.col("rank") == rank).select("pid", "term", "offset")
        wanted = starts.join(small(step, BROADCAST), "pid", "left").select("pid", "key", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
        there = wanted.where("term is not null").join(index, ["term", "key", "pos"], "left_semi")
        starts = there.unionByName(wanted.where("term is null")).select("pid", "key", "start")
    return starts


def exact(space: Workspace, starts: DataFrame, phrases: DataFrame, docs: DataFrame) -> DataFrame:
    """The starts where the document's words are the phrase's words."""
    starts = space.save(starts.distinct(), "starts")
    asked = space.save(starts.select("key").distinct(), "asked")
    texts = docs.join(small(asked, BROADCAST), "key", "left_semi").select("key", words().alias("w"))
    wanted = starts.join(small(phrases, BROADCAST), "pid")
    met = texts.join(wanted, "key").where(F.expr("slice(w, start + 1, n)") == F.col("words"))
    return met.select("pid", "key", "start", "n").distinct()


def proximity(phrases: DataFrame, index: DataFrame, frequency: DataFrame, slop: int) -> DataFrame:
    """(pid, key, at): each of the phrase's words stands within ``slop`` of its place, counted from an occurrence ``at`` of the rarest.

    ``index`` must hold all terms of the phrases. Lists are joined on (term, key, stretch of
    positions), so only places near each other in one document meet.
    """
    probes = probes_of(phrases, frequency, 1 << 20)
    anchors = probes.where("rank = 1").select("pid", F.col("term"), F.col("offset").alias("from"))
    at = index.join(anchors, "term").select("pid", "key", F.col("pos").alias("at"), "from")
    wanted = at.join(probes, "pid").withColumnRenamed("term", "need").withColumn("place", F.col("at") - F.col("from") + F.col("offset"))
    # Places are joined by stretches of 2 slop + 1, of which a window meets one or two, so a term
    # that is frequent in a long document meets only what stands near.
    stretch = lambda x: F.floor(x / F.lit(2 * slop + 1)).cast("long")
    wanted = wanted.withColumn("stretch", F.explode(F.array_distinct(F.array(stretch(F.col("place") - slop), stretch(F.col("place") + slop)))))
    held = index.select(F.col("term").alias("need"), "key", "pos", stretch(F.col("pos")).alias("stretch"))
    near = wanted.join(held, ["need", "key", "stretch"]).where(F.abs(F.col("pos") - F.col("place")) <= slop)
    met = near.groupBy("pid", "key", "at").agg(F.countDistinct("offset").alias("found"))
    return met.join(phrases, "pid").where("found = n").select("pid", "key", "at")


def matches(space: Workspace, docs: DataFrame, items: DataFrame, size: int = 10, lists: int = 2) -> tuple[DataFrame, DataFrame]:
    """All exact occurrences (pid, key, start, n) of the items' phrases in ``docs(key, text)``, and (pid, item_id)."""
    phrases, owners = phrases_of(space, items, size)
    vocabulary = space.save(phrases.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    counted = tokens(docs).join(small(vocabulary, BROADCAST), "term", "left_semi").groupBy("term").count()
    probes = space.save(probes_of(phrases, space.save(counted, "frequency"), lists), "probes")
    index = space.save(build_index(docs, space.save(probes.select("term").distinct(), "terms")), "index")
    return space.save(exact(space, intersect(probes, index, lists), phrases, docs), "hits"), owners


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs(doc_id, text)``."""
    space = Workspace(docs.sparkSession, "decontam")
    docs = docs.select("doc_id", "text", row_key().alias("key"))
    hits, owners = matches(space, docs.select("key", "text"), items.select("item_id", "text"))
    spans = hits.select("key", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = F.max("end").over(Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    covered = spans.withColumn("new", new).groupBy("key").agg(F.sum("new").alias("n_hit"))
    named = hits.select("key", "pid").distinct().join(owners, "pid").where("item_id is not null").select("key", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    found = space.save(covered.join(named, "key", "left"), "documents-hit")
    out = docs.select("doc_id", "key", F.coalesce(F.size(raw_words()), F.lit(0)).cast("long").alias("n_words")).join(found, "key", "left")
    return out.select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def oracle() -> str:
    """DuckDB SQL for ``contamination`` without the key."""
    split = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with d as (select doc_id, row_number() over () as row_no, coalesce({split}, []) as w from documents),
b as (select item_id, {split} as w from benchmark),
phrases as (select distinct item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as phrase, least(10, len(w)) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from phrases),
places as (select row_no, n, i, array_to_string(w[i:i + n - 1], ' ') as phrase from (
  select row_no, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select row_no, i, p.n, item_id from places p join phrases q on p.phrase = q.phrase and p.n = q.n),
covered as (select row_no, count(distinct place) as n_hit from (select row_no, unnest(range(i, i + n)) as place from hits) group by row_no),
named as (select row_no, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct row_no, item_id::varchar as item from hits where item_id is not null) group by row_no)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join covered using (row_no) left join named using (row_no)"""
