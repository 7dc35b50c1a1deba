"""Character n-gram TF-IDF as tables: one row for each record and gram, so that vectors, indexes and products are joins.

Weights are rounded to 9 places before they are cut and scores to 6 before they are ranked, and every order ends in a unique key, so that
results do not depend on the order of summation.

Over many records the long table of all grams is far larger than the texts, so retrieval and cosines of pairs never write or shuffle it:
texts and weights meet in blocks of a country, and numpy makes the vectors there. Nothing but texts, weights (once for each block), cut
vectors (a row for each record) and the best of a block (a row for each query) travels. A vector travels once for each block of the other
side, so blocks are as large as a task's memory allows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import chain
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import kept

#: Records, and pairs, that are vectorised with one copy of a country's weights; queries that meet twice as many records in one task.
ROWS, PAIRS, BLOCK = 8192, 32_768, 32_768
#: Keys that are broadcast.
_FEW = 1 << 20
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")  # \s of Java


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Grams within each white-space token with a blank on either side; a token no longer than n counts once, as a whole."""

    def of_token(t: Column) -> Column:
        size = F.length(t)
        return F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.greatest(F.lit(low), size))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(t, i, n))))

    toks = F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), lambda t: F.concat(F.lit(" "), t, F.lit(" ")))
    return F.flatten(F.transform(toks, of_token))


def gram_counts(records: DataFrame, text: str, keys: list[str], low: int = 2, high: int = 4) -> DataFrame:
    """keys, gram, tf. Records are dealt out by their keys before their grams are listed, so the count needs no shuffle of grams."""
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = records.select(*keys, text).repartition(n, *keys)
    return dealt.select(*keys, F.explode(char_ngrams(F.col(text), low, high)).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("tf"))


def fit_idf(counts: DataFrame, records: DataFrame, by: list[str], min_df: int = 2) -> DataFrame:
    """by, gram, df, n_docs, idf: smoothed, from all records. Groups of fewer than 50 * min_df records keep all grams."""
    return _weights(counts.groupBy(*by, "gram").agg(F.count("*").alias("df")), records, by, min_df)


def _weights(found: DataFrame, records: DataFrame, by: list[str], min_df: int) -> DataFrame:
    docs = records.groupBy(*by).agg(F.count("*").alias("n_docs"))
    found = found.join(docs, by)
    found = found.where(F.col("df") >= F.when(F.col("n_docs") >= 50 * min_df, min_df).otherwise(1))
    return found.withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)


def idf_of_texts(records: DataFrame, text: str, by: str, row: list[str], low: int = 2, high: int = 4, min_df: int = 2) -> DataFrame:
    """fit_idf of the counts of records' grams, which are counted where the texts are; row: what tells records apart, with by."""

    def count(batches):
        grams, found = {}, {}
        part = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((k, g, n) for k, f in found.items() for g, n in f.items())), (pa.string(), pa.string(), pa.int64()))], names=[by, "gram", "n"])
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(k, Counter()).update(set(chain.from_iterable(_token_grams(t, grams, low, high))))
            if sum(map(len, found.values())) > 400_000:
                yield part()
                found.clear()
        if any(found.values()):
            yield part()

    kind = records.schema[by].dataType.simpleString()
    counted = _whole(records, text, row).select(by, text).mapInArrow(count, f"{by} {kind}, gram string, n long")
    return _weights(counted.groupBy(by, "gram").agg(F.sum("n").alias("df")), records, [by], min_df)


def _whole(records: DataFrame, text: str, row: list[str]) -> DataFrame:
    """row and text, once for each record: grams stay within tokens, so a blank may stand between the texts of rows that share a key. All keys
    are looked at for that, but only texts of rows that share one travel."""
    records = records.select(*row, F.coalesce(text, F.lit("")).alias(text))
    again = kept(records.groupBy(*row).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in row]))
    n = again.count()
    if not n:
        return records
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in row])
    again = F.broadcast(again) if n <= _FEW else again
    several = records.join(again, same, "left_semi").groupBy(*row).agg(F.concat_ws(" ", F.collect_list(text)).alias(text))
    return records.join(again, same, "left_anti").unionByName(several)


def _token_grams(text: str, known: dict, low: int, high: int, of=lambda grams: grams) -> list:
    """of(grams of a token) for each token of text, as char_ngrams has them; known holds those met before."""
    out = []
    for t in _BLANKS.split(text):
        if t:
            if (got := known.get(t)) is None:
                p, n = f" {t} ", len(t) + 2
                if len(known) > 200_000:
                    known.clear()
                got = known[t] = of([p[i : i + k] for k in range(low, min(high, max(low, n)) + 1) for i in range(max(n - k + 1, 1))])
            out.append(got)
    return out


class Weights:
    """A country's grams, numbered in their order, and vectors of texts by them: (start of each row and the end, numbers, weights in 1e-9)."""

    def __init__(self, grams: list[str], idf: list[float], low: int, high: int):
        order = sorted(range(len(grams)), key=grams.__getitem__)
        self.number, self.idf = {grams[j]: i for i, j in enumerate(order)}, np.array(idf, float)[order]
        self.low, self.high, self.known = low, high, {}

    def _numbers(self, grams: list[str]) -> np.ndarray:
        return np.array([i for g in grams if (i := self.number.get(g)) is not None], np.int64)

    def vectors(self, texts: list[str], top: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = [_token_grams(t, self.known, self.low, self.high, self._numbers) for t in texts]
        sizes = [sum(map(len, r)) for r in rows]
        size, flat = max(len(self.idf), 1), [x for r in rows for x in r]
        key, tf = np.unique(np.repeat(np.arange(len(texts)), sizes) * size + (np.concatenate(flat) if flat else np.zeros(0, np.int64)), return_counts=True)
        row, gram = key // size, key % size
        w = (1 + np.log(tf)) * self.idf[gram]
        w = _unit(row, w, len(texts))
        if top > 0:
            order = np.argsort((row << 31) + (1_000_000_000 - w), kind="stable")  # heaviest first, then by gram
            start = np.searchsorted(row, np.arange(len(texts)))
            order = order[np.arange(len(row)) - start[row] < top]
            row, gram, w = row[order], gram[order], w[order]
            w = _unit(row, w / 1e9, len(texts))
        return np.searchsorted(row, np.arange(len(texts) + 1)), gram.astype(np.int32), w.astype(np.int32)


def _unit(row: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """w at unit length by row, in whole 1e-9."""
    return np.floor(w / np.sqrt(np.bincount(row, w * w, n))[row] * 1e9 + 0.5).astype(np.int64)


def _blocks(sizes: DataFrame, by: list[str], rows: int) -> DataFrame:
    """by and blocks: how many blocks of at most some `rows` rows there are; sizes: by, n."""
    return F.broadcast(sizes.select(*by, F.greatest(F.ceil(F.col("n") / rows), F.lit(1)).cast("int").alias("blocks")))


def _block(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.col("blocks")).cast("int")


def _met(left: DataFrame, right: DataFrame, key: list[str], f, schema: str) -> DataFrame:
    """f of the rows of either side that share key; both may come from the same table, hence the new columns."""
    left, right = (x.toDF(*x.columns) for x in (left, right))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(f, schema)


def heaviest(rows: DataFrame, idf: DataFrame, text: str, top: int, low: int = 2, high: int = 4) -> DataFrame:
    """(part, source, entity_id, ids, w) of rows (part, source, entity_id, text): prune() of their vectors, a row each, grams by their number
    within the part and weights in 1e-9. idf: part, gram, idf."""

    def cut(texts: pa.Table, weights: pa.Table) -> pa.Table:
        made = Weights(weights["gram"].to_pylist(), weights["idf"].to_pylist(), low, high)
        texts, out = _joined(texts, text), []
        for at in range(0, max(texts.num_rows, 1), 1024):
            some = texts.slice(at, 1024)
            start, ids, w = made.vectors(some[text].to_pylist(), top)
            lists = [pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(x)) for x in (ids, w)]
            out.append(pa.table([*(some[c] for c in ("part", "source", "entity_id")), *lists], names=["part", "source", "entity_id", "ids", "w"]))
        return pa.concat_tables(out)

    n = _blocks(rows.groupBy("part").agg(F.count("*").alias("n")), ["part"], ROWS)
    left = rows.join(n, "part").select("part", "source", "entity_id", F.coalesce(text, F.lit("")).alias(text), _block("entity_id").alias("block"))
    right = idf.join(n, "part").select("part", "gram", "idf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    v = _met(left, right, ["part", "block"], cut, "part string, source string, entity_id string, ids array<int>, w array<int>")
    return v.where(F.size("ids") > 0)


def _joined(t: pa.Table, text: str) -> pa.Table:
    """t with one row for each source and entity_id: rows of a record are in one block, as the block follows from the entity_id."""
    names = list(zip(t["source"].to_pylist(), t["entity_id"].to_pylist()))
    first: dict = {}
    for i, x in enumerate(names):
        first.setdefault(x, []).append(i)
    if len(first) == len(names):
        return t
    texts = t[text].to_pylist()
    whole = pa.array([" ".join(texts[i] for i in at) for at in first.values()], pa.string())
    t = t.take(pa.array([at[0] for at in first.values()]))
    return t.set_column(t.column_names.index(text), text, whole)


def with_fallback(wanted: DataFrame, idf: DataFrame) -> DataFrame:
    """(ckey, fitted): the country whose IDF a country uses, its own or else the first that was fitted."""
    have = idf.select(F.col("ckey").alias("fitted")).distinct()
    first = have.agg(F.min("fitted").alias("first"))
    return wanted.select("ckey").distinct().join(have, F.col("ckey") == F.col("fitted"), "left").crossJoin(F.broadcast(first)).select("ckey", F.coalesce("fitted", "first").alias("fitted"))


def missing_countries(wanted: DataFrame, idf: DataFrame) -> DataFrame:
    """Countries of wanted for which nothing was fitted."""
    return wanted.select("ckey").distinct().join(idf.select("ckey").distinct(), "ckey", "left_anti")


def vectors(counts: DataFrame, idf: DataFrame, by: list[str], row: list[str]) -> DataFrame:
    """row, gram, w: sublinear term frequency times IDF, unit length, 9 places. Grams without IDF drop out."""
    v = counts.join(idf.select(*by, "gram", "idf"), [*by, "gram"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*row)))
    return v.withColumn("w", F.round(F.col("w") / norm, 9))


def prune(v: DataFrame, row: list[str], top: int = 48) -> DataFrame:
    """The top heaviest grams of each row, unit length again. top <= 0: all."""
    if top <= 0:
        return v
    rank = F.row_number().over(W.partitionBy(*row).orderBy(F.col("w").desc(), "gram"))
    v = v.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*row)))
    return v.withColumn("w", F.round(F.col("w") / norm, 9))


def cap_postings(pool: DataFrame, sizes: DataFrame, by: list[str], fraction: float = 0.02, least: int = 50) -> DataFrame:
    """pool without grams in more than max(fraction * n, least) of a group's records; sizes: by, n. Runs before any join on grams."""
    df = pool.groupBy(*by, "gram").agg(F.count("*").alias("df")).join(sizes, by)
    kept = df.where(F.col("df") <= F.greatest(F.floor(fraction * F.col("n")), F.lit(least))).select(*by, "gram")
    return pool.join(kept, [*by, "gram"], "left_semi")


def spread(records: DataFrame, countries: DataFrame) -> DataFrame:
    """records with part: their country, or each of countries (part) for records without one. Records of other countries drop out."""
    own = records.where("ckey <> ''").withColumn("part", F.col("ckey")).join(F.broadcast(countries), "part", "left_semi")
    blank = records.where("ckey = ''").crossJoin(F.broadcast(countries))
    return own.select(*records.columns, "part").unionByName(blank.select(*records.columns, "part"))


def search_countries(queries: DataFrame) -> DataFrame:
    """(part): the countries of the queries, or '' if none has one. As many rows as there are countries."""
    some = queries.where("ckey <> ''").select(F.col("ckey").alias("part")).distinct()
    n = some.agg(F.count("*").alias("n"))
    return some.unionByName(n.where("n = 0").select(F.lit("").alias("part")))


def top_k(records: DataFrame, idf: DataFrame, text: str, k: int, top: int = 48, fraction: float = 0.02, query_source: str = "S1", ngrams: tuple[int, int] = (2, 4)) -> DataFrame:
    """(q, p, source, part, score, rank): for each query and each other source the k records with the largest cosine.

    records: entity_id, source, ckey, <text>; idf: ckey, gram, idf. Queries are not cut again after the cap on the pool's grams.
    """
    idf = kept(idf.select("ckey", "gram", "idf"))
    countries = search_countries(records.where(F.col("source") == query_source))
    rows = spread(records.select("entity_id", "source", "ckey", text), countries)
    fitted = with_fallback(rows.select(F.col("part").alias("ckey")), idf).withColumnRenamed("ckey", "part")
    own = idf.withColumnRenamed("ckey", "fitted").join(F.broadcast(fitted), "fitted").select("part", "gram", "idf")
    v = kept(heaviest(rows, own, text, top, *ngrams))  # read by the pool, its counts and the queries
    sizes = kept(rows.groupBy("part", "source").agg(F.count("*").alias("n")))
    is_query = F.col("source") == query_source
    pool_sizes, query_sizes = sizes.where(~is_query), sizes.where(is_query).drop("source")
    # the grams above the cap are few (a record has `top` grams), and go to every task as one more row of the pool
    common = v.where(~is_query).select("part", "source", F.explode("ids").alias("id")).groupBy("part", "source", "id").agg(F.count("*").alias("df")).join(F.broadcast(pool_sizes), ["part", "source"])
    common = common.where(F.col("df") > F.greatest(F.floor(fraction * F.col("n")), F.lit(50))).groupBy("part", "source").agg(F.collect_list("id").alias("ids"))
    pools, askers = _blocks(pool_sizes, ["part", "source"], 2 * BLOCK), _blocks(query_sizes, ["part"], BLOCK)
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pool_cells, query_cells = F.broadcast(pools.select("part", "source", each.alias("pb"))), F.broadcast(askers.select("part", each.alias("qb")))
    pool = v.where(~is_query).join(pools, ["part", "source"]).select("part", "source", _block("entity_id").alias("pb"), "entity_id", "ids", "w")
    none = F.lit(None)
    pool = pool.unionByName(common.join(pool_cells, ["part", "source"]).select("part", "source", "pb", none.cast("string").alias("entity_id"), "ids", none.cast("array<int>").alias("w"))).join(query_cells, "part")
    queries = v.where(is_query).join(askers, "part").select("part", _block("entity_id").alias("qb"), "entity_id", "ids", "w").join(pool_cells, "part")
    cell = ["part", "source", "qb", "pb"]
    nearest = lambda a, b: _nearest(a, b, k)
    hits = _met(queries, pool, cell, nearest, "q string, source string, part string, p array<string>, score array<double>")
    # best first, then by p
    listed = F.transform(F.arrays_zip("score", "p"), lambda x: F.struct((-x["score"]).alias("less"), x["p"].alias("p")))
    best = hits.groupBy("part", "source", "q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(listed))), 1, k).alias("best"))
    each = best.select("q", "source", "part", F.posexplode("best").alias("place", "x"))
    return each.select("q", F.col("x.p").alias("p"), "source", "part", (-F.col("x.less")).alias("score"), (F.col("place") + 1).alias("rank"))


def _lists(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and weight of all entries of ids and w."""
    ids, w = (t[c].combine_chunks() for c in ("ids", "w"))
    flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(t.num_rows), ids.value_lengths().to_numpy(zero_copy_only=False)), flat(ids), flat(w) / 1e9


def _nearest(queries: pa.Table, pool: pa.Table, k: int, room: int = 4_000_000) -> pa.Table:
    """(q, source, part, p, score): for each query that finds any the k best of the pool, exactly, as lists, best first. A row of the pool
    without entity_id has the grams that do not count. room: products, and sums, that are held at once."""
    whole = pool["entity_id"].is_valid()
    banned, pool = _flat_ids(pool.filter(pa.compute.invert(whole))), pool.filter(whole)
    names = pool["entity_id"].to_pylist()
    pool = pool.take(pa.array(sorted(range(len(names)), key=names.__getitem__), pa.int64()))
    row, gram, w = _lists(pool)
    fine = ~np.isin(gram, banned)
    row, gram, w = row[fine], gram[fine], w[fine]
    order = np.argsort(gram, kind="stable")
    row, gram, w = row[order], gram[order], w[order]
    n, (q_row, q_gram, q_w) = pool.num_rows, _lists(queries)
    first, last = np.searchsorted(gram, q_gram, "left"), np.searchsorted(gram, q_gram, "right")
    met = np.concatenate([[0], np.cumsum(last - first)])
    begins = np.searchsorted(q_row, np.arange(queries.num_rows + 1))
    out, a = [], 0
    while a < queries.num_rows and n:
        # as many queries as there is room for, one at least
        b = min(a + max(1, room // n), int(np.searchsorted(met[begins], met[begins[a]] + room, "right")) - 1, queries.num_rows)
        b = max(b, a + 1)
        e = slice(begins[a], begins[b])
        count = (last - first)[e]
        total = int(count.sum())
        at = np.repeat(first[e] - np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count) + np.arange(total) if total else np.zeros(0, np.int64)
        dots = np.bincount(np.repeat((q_row[e] - a) * n, count) + row[at], np.repeat(q_w[e], count) * w[at], (b - a) * n).reshape(b - a, n)
        score = np.where(dots > 0, np.floor(dots * 1e6 + 0.5), -1)
        least = np.partition(score, n - k, axis=1)[:, n - k, None] if n > k else np.zeros((b - a, 1))
        i, j = np.nonzero((score >= least) & (score >= 0))
        s = score[i, j]
        best = np.lexsort((j, -s, i))
        i, j, s = i[best], j[best], s[best]
        first_of = np.searchsorted(i, np.arange(b - a))
        held = np.arange(len(i)) - first_of[i] < k
        out.append((i[held] + a, j[held], s[held] / 1e6))
        a = b
    i, j, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    start = np.flatnonzero(np.diff(i, prepend=-1))
    ends = pa.array(np.append(start, len(i)), pa.int32())
    some = [queries[c].take(pa.array(i[start])) for c in ("entity_id", "source", "part")]
    found = pool["entity_id"].combine_chunks().take(pa.array(j))
    return pa.table([*some, pa.ListArray.from_arrays(ends, found), pa.ListArray.from_arrays(ends, pa.array(s))], names=["q", "source", "part", "p", "score"])


def _flat_ids(t: pa.Table) -> np.ndarray:
    return t["ids"].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def text_cosine(pairs: DataFrame, left: str, right: str, texts: DataFrame, text: str, idf: DataFrame, out: str, low: int = 2, high: int = 4) -> DataFrame:
    """pairs with out: the cosine of the two records' full vectors under the weights of part, 6 places, 0 if they share no gram.

    pairs: part, <left>, <right>; texts: entity_id, <text>, and part if a text counts for one part only; idf: part, gram, idf.
    """
    some = pairs.select("part", F.col(left).alias("_l"), F.col(right).alias("_r")).distinct()
    n = _blocks(some.groupBy("part").agg(F.count("*").alias("n")), ["part"], PAIRS)
    some = some.join(n, "part").select("part", _block("_l").alias("block"), "_l", "_r")
    key = ["part", "entity_id"] if "part" in texts.columns else ["entity_id"]
    needed = some.select("part", "block", F.explode(F.array("_l", "_r")).alias("entity_id")).distinct()
    there = needed.join(_whole(texts, text, key), key).select("part", "block", F.col("entity_id").alias("key"), F.col(text).alias("text"), F.lit(None).cast("double").alias("idf"))
    weights = idf.join(n, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("gram").alias("key"), F.lit(None).cast("string").alias("text"), "idf")

    def cosines(a: pa.Table, b: pa.Table) -> pa.Table:
        is_text = b["text"].is_valid()
        grams, held = b.filter(pa.compute.invert(is_text)), b.filter(is_text)
        made = Weights(grams["key"].to_pylist(), grams["idf"].to_pylist(), low, high)
        return _cosines(a, dict(zip(held["key"].to_pylist(), held["text"].to_pylist())), made).rename_columns(["part", left, right, out])

    found = _met(some, there.unionByName(weights), ["part", "block"], cosines, f"part string, {left} string, {right} string, {out} double")
    return pairs.join(found, ["part", left, right], "left")


def _cosines(pairs: pa.Table, texts: dict[str, str], made: Weights, step: int = 4096) -> pa.Table:
    names = list(zip(pairs["_l"].to_pylist(), pairs["_r"].to_pylist()))
    order = sorted(range(len(names)), key=names.__getitem__)
    out, dense = np.zeros(len(names)), np.zeros(max(len(made.idf), 1))
    for at in range(0, len(order), step):
        here = order[at : at + step]
        own = {x: i for i, x in enumerate(dict.fromkeys(chain.from_iterable(names[i] for i in here)))}
        start, ids, w = made.vectors([texts.get(x, "") for x in own])
        w = w / 1e9
        l, r = (np.array([own[names[i][side]] for i in here]) for side in (0, 1))
        cut = [0, *(np.flatnonzero(l[1:] != l[:-1]) + 1), len(l)]
        for a, b in zip(cut, cut[1:]):
            mine = slice(start[l[a]], start[l[a] + 1])
            dense[ids[mine]] = w[mine]
            size = start[r[a:b] + 1] - start[r[a:b]]
            e = np.repeat(start[r[a:b]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            out[here[a:b]] = np.bincount(np.repeat(np.arange(b - a), size), dense[ids[e]] * w[e], b - a)
            dense[ids[mine]] = 0
    return pairs.select(["part", "_l", "_r"]).append_column("cos", pa.array(np.floor(out * 1e6 + 0.5) / 1e6))


def pair_cosine(pairs: DataFrame, left: str, right: str, v: DataFrame, out: str) -> DataFrame:
    """pairs with out: the cosine of the two records' full vectors (v: part, entity_id, gram, w), 6 places, null if either has none.

    pairs has a column part, the country whose weights count. Each record is vectorised once, whatever the number of its pairs.
    """
    some = pairs.select("part", F.col(left).alias("_l"), F.col(right).alias("_r")).distinct()
    a = v.select("part", F.col("entity_id").alias("_l"), "gram", F.col("w").alias("_wl"))
    b = v.select("part", F.col("entity_id").alias("_r"), "gram", F.col("w").alias("_wr"))
    dots = some.join(a, ["part", "_l"]).join(b, ["part", "_r", "gram"]).groupBy("part", "_l", "_r").agg(F.round(F.sum(F.col("_wl") * F.col("_wr")), 6).alias("_dot"))
    found = some.join(dots, ["part", "_l", "_r"], "left").select("part", F.col("_l").alias(left), F.col("_r").alias(right), F.coalesce("_dot", F.lit(0.0)).alias(out))
    return pairs.join(found, ["part", left, right], "left")


def token_idf(texts: DataFrame, text: str) -> DataFrame:
    """token, idf, default_idf (of an unknown token): smoothed IDF of distinct white-space tokens over all rows."""
    n = texts.agg(F.count("*").alias("n"))
    df = texts.select(F.explode(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: t != ""))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), (F.log(1 + F.col("n")) + 1).alias("default_idf"))
