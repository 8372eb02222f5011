"""Source divergence audit: how far the words of a source are from those of its language's other sources.

A text's bytes go through one ``bytes.translate``: letters A-Z are lowered and every byte below 128 that
is no letter becomes a blank, so ``bytes.split`` gives the terms. A Counter for each document gives
the counts; a task adds them up by language and source, with the number of documents of each term, and
hands on what it holds whenever that is ``HELD`` terms. All that follows is sparse: rows exist for
terms that occur.

A language keeps the terms in at least ``documents`` of its documents; V of them. In a group with N
occurrences of kept terms, a term of ``count`` has p = 1 + floor(scale (count + 1) / (N + V)), so
absent terms have one p of their own, and f = floor((p - q)^2 / q) needs whole numbers only. For a pair
of sources the sum of f over all kept terms is taken from three parts: terms both have, by a join
on the term; terms one of them has, from the numbers of terms by p; and the number of the rest.
The sums stay below 2**63: those of p are about ``scale`` and q is 1 or more.

Defined cases. Null text, lang and source are ''. A group without kept terms takes part with N = 0; a
language without kept terms has V = 0, all its pairs 0 and no term rows. Repeated rows are documents of
their own. An empty table gives no rows. Columns besides text, lang and source are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlife.llm.bytescan import pieces, texts
from merchlife.llm.storage import Workspace, small

# Fixed by the contract: letters A-Z lowered, other bytes below 128 blank, all else as it is.
BLANKED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ONE_DOCUMENT = 1 << 48  # a held number is occurrences + documents * 2**48
COUNTED = "lang string, source string, term string, n long, docs long"
GROUPS = 100_000  # groups up to this number are broadcast


@dataclass(frozen=True)
class Params:
    documents: int = 3
    scale: int = 1_000_000_000
    ranks: int = 200
    held: int = 400_000  # terms that a task holds before it hands them on


def term_counts(docs: DataFrame, held_terms: int) -> DataFrame:
    """(lang, source, term, n, docs) of ``docs(lang, source, text)``, several rows of a term possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0
        for batch in pieces(batches):
            data, offsets = texts(batch.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                found = Counter(raw[at[i] : at[i + 1]].translate(BLANKED).split())
                mine = held.setdefault(group, {})
                size -= len(mine)
                for term, n in found.items():
                    mine[term] = mine.get(term, 0) + n + ONE_DOCUMENT
                size += len(mine)
                if size > held_terms:
                    yield from _rows(held)
                    held, size = {}, 0
        yield from _rows(held)

    return docs.select("lang", "source", "text").mapInArrow(run, COUNTED)


def _rows(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), found in held.items():
        if found:
            terms = pa.array(list(found), pa.binary()).cast(pa.string())
            same = [pa.array([x] * len(found), pa.string()) for x in (lang, source)]
            n, in_docs = zip(*(divmod(v, ONE_DOCUMENT)[::-1] for v in found.values()), strict=True)
            yield pa.record_batch([*same, terms, pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def weight(count: str, total: str, terms: str, scale: int) -> Column:
    """p of a term of ``count`` in a group with ``total`` occurrences of the language's ``terms`` kept terms."""
    return F.expr(f"1 + (cast({scale} as decimal(10,0)) * (cast({count} as decimal(19,0)) + 1)) div (cast({total} as decimal(19,0)) + cast({terms} as decimal(19,0)))")


def distance(p: str, q: str) -> Column:
    """f; p and q are at most scale + 1, so the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def audit(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs(text, lang, source)``."""
    space = Workspace(docs.sparkSession, "divergence")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(blank("lang"), blank("source"), blank("text"))
    counts = space.save(term_counts(rows, p.held).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
    kept = space.save(by_term.where(F.col("docs") >= p.documents).select("lang", "term", "in_lang"), "kept")
    langs = kept.groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count("*").alias("terms"))
    found = space.save(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "found")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(small(langs, GROUPS), "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = space.save(groups.select("lang", "source", *(zero(c) for c in ("total", "present", "lang_total", "terms"))), "groups")
    nothing = F.when(F.col("terms") > 0, weight("0", "total", "greatest(terms, 1)", p.scale)).otherwise(F.lit(1).cast("long"))
    groups = space.save(groups.withColumn("absent", nothing), "rated-groups")
    rated = found.join(small(groups, GROUPS), ["lang", "source"])
    rated = rated.withColumns({"p": weight("n", "total", "terms", p.scale), "q": weight("in_lang", "lang_total", "terms", p.scale)})
    rated = space.save(rated.select("lang", "source", "term", "p", "q", "absent"), "rated")
    terms = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    pairs = _pairs(space, rated, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return _ranked(terms, p.ranks).union(_ranked(pairs, None))


def _ranked(rows: DataFrame, most: int | None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", place)
    return out if most is None else out.where(F.col("rank") <= most)


def _pairs(space: Workspace, rated: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language."""
    keys = ["lang", "a", "b"]
    side = lambda x: groups.select("lang", F.col("source").alias(x), F.col("present").alias(f"{x}_present"), F.col("absent").alias(f"{x}_absent"), *(["terms"] if x == "a" else []))
    both = space.save(side("a").join(side("b"), "lang").where("a <> b"), "pairs")  # as many as the result has
    few = small(both, GROUPS)
    none = F.lit(0).cast("long").alias("shared")
    by_p = space.save(rated.groupBy("lang", "source", "p").agg(F.count("*").alias("times")), "by-p")
    mine = by_p.withColumnRenamed("source", "a").join(few, ["lang", "a"]).groupBy(*keys).agg(F.sum(distance("p", "b_absent") * F.col("times")).alias("f"), none)
    theirs = by_p.withColumnRenamed("source", "b").join(few, ["lang", "b"]).groupBy(*keys).agg(F.sum(distance("a_absent", "p") * F.col("times")).alias("f"), none)
    one = rated.select("lang", "term", F.col("source").alias("a"), "p", F.col("absent").alias("a_absent"))
    other = rated.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("absent").alias("b_absent"))
    gain = distance("p", "q") - distance("p", "b_absent") - distance("a_absent", "q")
    met = one.join(other, ["lang", "term"]).where("a <> b").groupBy(*keys).agg(F.sum(gain).alias("f"), F.count("*").alias("shared"))
    parts = mine.union(theirs).union(met).groupBy(*keys).agg(F.sum("f").alias("f"), F.sum("shared").alias("shared"))
    out = both.join(parts, keys, "left")
    rest = F.expr("terms - a_present - b_present + coalesce(shared, 0)")
    value = F.coalesce("f", F.lit(0).cast("long")) + rest * distance("a_absent", "b_absent")
    return out.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.alias("value"))


def oracle(p: Params = Params()) -> str:
    """DuckDB SQL for ``audit`` over documents, from all terms of all groups."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    weight_of = lambda n, total: f"1 + ({p.scale}::hugeint * ({n} + 1)) // ({total} + terms)"
    return rf"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w, row_number() over () as row_no from documents),
words as (select lang, source, row_no, unnest(w) as term from d),
kept as (select lang, term, count(*)::hugeint as in_lang from words group by lang, term having count(distinct row_no) >= {p.documents}),
langs as (select lang, sum(in_lang)::hugeint as lang_total, count(*)::hugeint as terms from kept group by lang),
groups as (select distinct lang, source from d),
counts as (select lang, source, term, count(*)::hugeint as n from words group by lang, source, term),
dense as (select lang, source, term, in_lang, coalesce(n, 0)::hugeint as n from groups join kept using (lang) left join counts using (lang, source, term)),
totals as (select lang, source, sum(n)::hugeint as total from dense group by lang, source),
rated as materialized (select lang, source, term, n, {weight_of("n", "total")} as p, {weight_of("in_lang", "lang_total")} as q
  from dense join totals using (lang, source) join langs using (lang)),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from rated a join rated b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value from rated where n > 0 and p > q),
ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::integer as rank from (select * from every union all select * from terms))
select * from ranked where part = 'pair' or rank <= {p.ranks}"""
