"""Datasets composed from several sources of pairs, with exclusions, quotas, joint splits and checks.

A pair is one row: pair_id, split, and for either side (``pos``, ``neg``) its id, document and text:
pos_id, pos_document, pos_text, neg_id, neg_document, neg_text. Used and excluded sets are tables, and leaving them
out is an anti-join, so nothing here is collected but the shortfalls, a row a split and source at most.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators.graph import connected_components
from quarrymill.operators.pairing import first_by, zipped
from quarrymill.operators.splits import RATIOS, balanced
from quarrymill.runtime import stage

SIDES = ("pos", "neg")
#: split -> source -> pairs
Quotas = Mapping[str, Mapping[str, int]]


class Shortfall(ValueError):
    """A source cannot give as many pairs as its quota asks for; ``rows`` says which and by how much."""

    def __init__(self, rows: list):
        super().__init__("; ".join(f"{r['split']}/{r['source']}: {r['needed']} needed, {r['available']} available" for r in rows))
        self.rows = rows


def side(rows: DataFrame, name: str) -> DataFrame:
    """example_id, document_id, text as the columns of one side."""
    return rows.withColumnsRenamed({"example_id": f"{name}_id", "document_id": f"{name}_document", "text": f"{name}_text"})


def synthetic_pairs(rows: DataFrame, namespace: str) -> DataFrame:
    """Pairs of the i-th positive with the i-th negative of a split in hash order (no link in content).

    ``rows``: example_id, document_id, text, label, split.
    """
    of = lambda label, name: side(rows.where(F.col("label") == label).select("split", "example_id", "document_id", "text"), name)
    found = zipped(of(1, "pos"), of(0, "neg"), ["split"], T.rank_key(f"{namespace}-pos", "pos_id"), T.rank_key(f"{namespace}-neg", "neg_id"))
    return found.withColumn("pair_id", F.concat_ws("::", "pos_id", "neg_id"))


def linked_pairs(rows: DataFrame, negatives: DataFrame) -> DataFrame:
    """Pairs of positives (example_id, document_id, text, split) with the negatives (the same, and ``matched``: the
    positive's example_id) of their split; the positive's id is the pair's."""
    pos = side(rows.select("split", "example_id", "document_id", "text"), "pos")
    neg = side(negatives.select("split", F.col("matched").alias("pos_id"), "example_id", "document_id", "text"), "neg")
    return pos.join(neg, ["split", "pos_id"]).withColumn("pair_id", F.col("pos_id"))


def without(pairs: DataFrame, taken: DataFrame, what: str, by: tuple[str, ...] = ("split",), sides: tuple[str, ...] = SIDES) -> DataFrame:
    """Pairs none of whose sides has its ``what`` (id, document, text) among ``taken`` (``by`` and a column of that name)."""
    for s in sides:
        pairs = pairs.join(taken.select(*by, F.col(what).alias(f"{s}_{what}")).distinct(), [*by, f"{s}_{what}"], "left_anti")
    return pairs


def values(pairs: DataFrame, what: str) -> DataFrame:
    """split and the ``what`` of both sides."""
    return pairs.select("split", F.explode(F.array(*[f"{s}_{what}" for s in SIDES])).alias(what))


def within_quota(candidates: DataFrame, source: str, namespace: str, quotas: Quotas) -> tuple[DataFrame, DataFrame]:
    """The first pairs of each split in hash order, up to its quota, and the splits that fall short (split, source,
    needed, available). A source that falls short in a split adds nothing to it."""
    spark = candidates.sparkSession
    needs = F.broadcast(spark.createDataFrame([(s, q[source]) for s, q in quotas.items()], "split string, needed int"))
    ranked = candidates.withColumn("place", F.row_number().over(Window.partitionBy("split").orderBy(T.rank_key(f"{namespace}\0{source}", "pair_id"), "pair_id")))
    # a number, not a column: with it each task keeps only so many rows of a split before they meet
    ranked = ranked.where(F.col("place") <= max((q[source] for q in quotas.values()), default=0))
    ranked = stage(ranked.join(needs, "split").where("place <= needed"), "ranked")
    counts = ranked.groupBy("split").agg(F.count("*").alias("available"))
    short = needs.join(counts, "split", "left").na.fill(0, ["available"]).where("available < needed").select("split", F.lit(source).alias("source"), "needed", F.col("available").cast("int").alias("available"))
    return ranked.join(F.broadcast(short.select("split")), "split", "left_anti").drop("place", "needed").withColumn("source", F.lit(source)), short


def _checked(found: DataFrame, shorts: list[DataFrame], strict: bool) -> tuple[DataFrame, DataFrame]:
    short = shorts[0]
    for s in shorts[1:]:
        short = short.unionByName(s)
    if strict and (rows := short.collect()):  # a row a split and source at most
        raise Shortfall(rows)
    return found, short


def canonical_splits(*rows: DataFrame) -> DataFrame:
    """document_id and its split by the first of the sources (document_id, split) that has it."""
    every = None
    for k, r in enumerate(rows):
        one = r.select("document_id", "split").distinct().withColumn("k", F.lit(k))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("document_id").agg(F.min_by("split", F.struct("k", "split")).alias("canonical"))


def agreeing(pairs: DataFrame, canonical: DataFrame) -> DataFrame:
    """Pairs whose positive's document has the pair's split, or none, in ``canonical``."""
    known = canonical.withColumnRenamed("document_id", "pos_document")
    return pairs.join(known, "pos_document", "left").where("canonical is null or canonical = split").drop("canonical")


def combined_pure(sources: Mapping[str, DataFrame], quotas: Quotas, exclusive: tuple[str, ...] = ("pure_topic", "easy"), strict: bool = True, namespace: str = "combined_pure") -> tuple[DataFrame, DataFrame]:
    """Pairs of all sources in their order, and the shortfalls.

    Documents in any source's test split are left out of the other splits. In each split a pair is left out if an
    earlier source has used one of its ids or texts. Sources that are not ``exclusive`` were split on their own, so
    their pairs also have to agree with the split that the others give their document. With ``strict`` a shortfall
    raises.
    """
    tested = None
    for pairs in sources.values():
        docs = values(pairs.where("split = 'test'"), "document").select("document")
        tested = docs if tested is None else tested.union(docs)
    tested = stage(tested.distinct(), "tested")
    documents = lambda p: values(p, "document").withColumnRenamed("document", "document_id")
    canonical = stage(canonical_splits(*[documents(sources[s]) for s in sources if s in exclusive]), "canonical")
    chosen, shorts = None, []
    for name, pairs in sources.items():
        free = without(pairs.where("split <> 'test'"), tested, "document", ()).unionByName(pairs.where("split = 'test'"))
        if name not in exclusive:
            free = agreeing(free, canonical)
        if chosen is not None:
            free = without(without(free, values(chosen, "id"), "id"), values(chosen, "text"), "text")
        found, short = within_quota(free, name, namespace, quotas)
        shorts.append(short)
        chosen = stage(found if chosen is None else chosen.unionByName(found), "chosen")
    return _checked(chosen, shorts, strict)


def combined(easy: DataFrame, hybrid: DataFrame, preference: DataFrame, quotas: Quotas, strict: bool = True, namespace: str = "combined") -> tuple[DataFrame, DataFrame]:
    """Rows (split, source, pair_id, example_id, label) of three sources, and the shortfalls.

    ``easy`` (example_id, document_id, label, split) gives positives and negatives independently of each other;
    ``hybrid`` (pairs) gives pairs whose positive and whose negative ``easy`` has not used in that split;
    ``preference`` (pairs) gives pairs that agree with the splits that the other two give their document.
    """
    shorts = []
    picked = {}
    for label, name in ((1, "pos"), (0, "neg")):
        rows = easy.where(F.col("label") == label).select("split", F.col("example_id").alias("pair_id"))
        picked[name], short = within_quota(rows, "easy", f"{namespace}-{name}", quotas)
        shorts.append(short)
    # both sides or neither
    lacking = shorts[0].select("split").union(shorts[1].select("split")).distinct()
    picked = {k: stage(v.join(F.broadcast(lacking), "split", "left_anti"), k) for k, v in picked.items()}
    free = hybrid
    for s in SIDES:
        free = without(free, picked[s].withColumnRenamed("pair_id", "id"), "id", sides=(s,))
    mixed, short = within_quota(free, "hybrid", namespace, quotas)
    shorts.append(short)
    known = canonical_splits(easy, values(hybrid, "document").withColumnRenamed("document", "document_id"))
    preferred, short = within_quota(agreeing(preference, known), "preference", namespace, quotas)
    shorts.append(short)
    both = mixed.unionByName(preferred)
    out = both.select("split", "source", "pair_id", F.col("pos_id").alias("example_id"), F.lit(1).alias("label")).unionByName(both.select("split", "source", "pair_id", F.col("neg_id").alias("example_id"), F.lit(0).alias("label")))
    for label, name in ((1, "pos"), (0, "neg")):
        out = out.unionByName(picked[name].select("split", "source", F.lit(None).cast("string").alias("pair_id"), F.col("pair_id").alias("example_id"), F.lit(label).alias("label")))
    return _checked(stage(out, "combined"), shorts, strict)


def preference_heavy(pure: DataFrame, easy: DataFrame, preference: DataFrame, excluded: Mapping[str, DataFrame], namespace: str = "preference-heavy") -> DataFrame:
    """Pairs of three sources with ``source`` and a split that whole groups of linked documents share.

    ``excluded``: tables ``documents`` (document), ``texts`` (text, normalised) and ``pairs`` (pair_id) of test sets.
    ``pure`` (pairs) comes first and claims its positives; ``easy`` (example_id, document_id, text, label) pairs the
    positives that are left with one negative a document, in hash order; ``preference`` (pairs) has both sides in one
    document. The two documents of a pair go to the same split, over all sources: components of the documents' graph
    are dealt by the number of their pairs.
    """
    normal = lambda p: p.withColumns({f"{s}_text": T.normalise_key(f"{s}_text") for s in SIDES})
    keyed = lambda p: p.join(without(normal(p), excluded["texts"], "text", ()).select("pair_id"), "pair_id", "left_semi")
    pure = stage(keyed(without(pure, excluded["documents"], "document", ())).drop("split"), "pure")
    free = easy.join(excluded["documents"].select(F.col("document").alias("document_id")).distinct(), "document_id", "left_anti")
    pos = free.where("label = 1").join(pure.select(F.col("pos_id").alias("example_id")).distinct(), "example_id", "left_anti")
    neg = free.where("label = 0").withColumn("key", T.rank_key(f"{namespace}-easy-neg", "example_id"))
    neg = first_by(neg, ["document_id"], "key", "example_id").drop("key")
    both = pos.select("example_id", "document_id", "text", F.lit(1).alias("label")).unionByName(neg.select("example_id", "document_id", "text", F.lit(0).alias("label")))
    simple = synthetic_pairs(both.withColumn("split", F.lit("")), f"{namespace}-easy").drop("split")
    own = keyed(without(preference, excluded["documents"], "document", ())).join(excluded["pairs"].select("pair_id").distinct(), "pair_id", "left_anti").drop("split")
    pairs = None
    for name, rows in (("pure_topic", pure), ("easy", simple), ("preference", own)):
        rows = rows.withColumn("source", F.lit(name))
        pairs = rows if pairs is None else pairs.unionByName(rows)
    pairs = stage(pairs, "pairs")
    components = connected_components(pairs.select(F.col("pos_document").alias("src"), F.col("neg_document").alias("dst")))
    named = pairs.join(components.select(F.col("id").alias("pos_document"), "component"), "pos_document")
    weights = named.groupBy("component").agg(F.count("*").alias("size")).select(F.lit(namespace).alias("stratum"), F.col("component").alias("document_id"), "size")
    splits = balanced(weights, RATIOS).select(F.col("document_id").alias("component"), "split")
    return named.join(splits, "component").drop("component")


def rows_of(pairs: DataFrame) -> DataFrame:
    """example_id, document_id, text, label, split, source, pair_id of both sides."""
    one = lambda s, label: F.struct(F.col(f"{s}_id").alias("example_id"), F.col(f"{s}_document").alias("document_id"), F.col(f"{s}_text").alias("text"), F.lit(label).alias("label"))
    return pairs.select("split", "source", "pair_id", F.inline(F.array(one("pos", 1), one("neg", 0))))


def _check(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), value.cast("long").alias("violations"))


def leakage(rows: DataFrame, documents: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """check, violations: duplicate ids and texts, documents in several splits, normalised texts in two splits, excluded
    documents and texts that are there all the same, and (split, source) groups with unequal labels.

    ``rows``: as ``rows_of`` gives them; ``documents`` (document) and ``texts`` (text, normalised) are the excluded ones.
    """
    rows = stage(rows.select("example_id", "document_id", "label", "split", "source", F.md5("text").alias("text"), F.md5(T.normalise_key("text")).alias("normal")), "checked")
    whole = rows.agg((F.count("*") - F.count_distinct("example_id")).alias("ids"), (F.count("*") - F.count_distinct("text")).alias("texts"))
    found = [whole.select(F.inline(F.array(_check("duplicate_ids", F.col("ids")), _check("duplicate_texts", F.col("texts")))))]
    crossing = rows.groupBy("document_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    found.append(crossing.agg(F.count("*").alias("n")).select(F.inline(F.array(_check("leaking_documents", F.col("n"))))))
    held = rows.groupBy("normal").agg(F.collect_set("split").alias("splits")).where("size(splits) > 1")  # a split is one of three
    names = sorted(RATIOS)
    shared = {f"{a}_{b}": F.count_if(F.array_contains("splits", a) & F.array_contains("splits", b)) for k, a in enumerate(names) for b in names[k + 1 :]}
    found.append(held.agg(*[v.alias(k) for k, v in shared.items()]).select(F.inline(F.array(*[_check(f"shared_texts_{k}", F.col(k)) for k in shared]))))
    if documents is not None:
        back = rows.select("document_id").distinct().join(documents.select(F.col("document").alias("document_id")).distinct(), "document_id", "left_semi")
        found.append(back.agg(F.count("*").alias("n")).select(F.inline(F.array(_check("excluded_documents", F.col("n"))))))
    if texts is not None:
        back = rows.select("normal").distinct().join(texts.select(F.md5("text").alias("normal")).distinct(), "normal", "left_semi")
        found.append(back.agg(F.count("*").alias("n")).select(F.inline(F.array(_check("excluded_texts", F.col("n"))))))
    uneven = rows.groupBy("split", "source").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(-1)).alias("n")).where("n <> 0")
    found.append(uneven.agg(F.count("*").alias("n")).select(F.inline(F.array(_check("uneven_groups", F.col("n"))))))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def verified(datasets: Mapping[str, DataFrame], uneven: tuple[str, ...], candidates: DataFrame, common: DataFrame, metrics: DataFrame, scores: DataFrame) -> DataFrame:
    """check, status (PASS, FAIL, or NOTE for what is only to be known), detail of a whole experiment.

    ``datasets``: name -> example_id, document_id, text, label, split; those in ``uneven`` need no equal labels.
    ``candidates`` and ``common`` (candidate_id): test candidates that have to be the same set. ``metrics``: rows with a
    number ``value`` that may not be NaN. ``scores``: rows with a ``probability`` that may not be missing.
    """
    state = lambda bad, other="FAIL": F.when(bad == 0, "PASS").otherwise(other)
    row = lambda name, bad, other="FAIL": F.struct(F.lit(name).alias("check"), state(bad, other).alias("status"), bad.cast("long").alias("detail"))
    every = None
    for name, rows in datasets.items():
        one = rows.select(F.lit(name).alias("dataset"), "example_id", "document_id", F.md5("text").alias("text"), "label", "split")
        every = one if every is None else every.unionByName(one)
    every = stage(every, "verified")
    counted = every.groupBy("dataset").agg((F.count("*") - F.count_distinct("example_id")).alias("ids"), (F.count("*") - F.count_distinct("text")).alias("texts"), F.abs(F.sum(F.when(F.col("label") == 1, 1).otherwise(-1))).alias("uneven"))
    crossing = every.groupBy("dataset", "document_id").agg(F.count_distinct("split").alias("n")).groupBy("dataset").agg(F.count_if(F.col("n") > 1).alias("leaking"))
    names = every.sparkSession.createDataFrame([(n,) for n in datasets], "dataset string")
    each = F.broadcast(names).join(counted, "dataset", "left").join(crossing, "dataset", "left").na.fill(0)
    named = lambda what: F.concat_ws(": ", "dataset", F.lit(what))
    balance = F.when(F.col("dataset").isin(*uneven), 0).otherwise(F.col("uneven")) if uneven else F.col("uneven")
    told = each.select(F.inline(F.array(*[F.struct(named(what).alias("check"), state(bad).alias("status"), bad.cast("long").alias("detail")) for what, bad in (("no duplicate ids", F.col("ids")), ("no duplicate texts", F.col("texts")), ("no document in two splits", F.col("leaking")), ("equal labels", balance))])))
    conflict = every.groupBy("document_id").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    told = told.unionByName(conflict.select(F.inline(F.array(row("no document with two splits over all datasets", F.col("n"), "NOTE")))))
    a, b = (x.select("candidate_id").distinct() for x in (candidates, common))
    differing = a.join(b, "candidate_id", "left_anti").union(b.join(a, "candidate_id", "left_anti")).agg(F.count("*").alias("n"))
    told = told.unionByName(differing.select(F.inline(F.array(row("test candidates are the common ones", F.col("n"))))))
    told = told.unionByName(metrics.agg(F.count_if(F.isnan("value")).alias("n")).select(F.inline(F.array(row("no metric is NaN", F.col("n"))))))
    return told.unionByName(scores.agg(F.count_if(F.col("probability").isNull()).alias("n")).select(F.inline(F.array(row("no probability is missing", F.col("n"))))))


def merged_runs(runs: DataFrame) -> DataFrame:
    """The best row of each passage over all runs, then of each page: example_id, page_id, score and run.

    A page that two passages have chosen stays with the better score; ties go to the earlier run, then the smaller id.
    """
    best = first_by(runs, ["example_id"], F.desc("score"), "run", "page_id")
    return first_by(best, ["page_id"], F.desc("score"), "example_id")


def hybrid(passages: DataFrame, topic: DataFrame, easy: DataFrame, strict: bool = True, namespace: str = "hybrid") -> tuple[DataFrame, DataFrame]:
    """example_id, split, negative_id, kind of every passage, and the shortfalls.

    ``passages``: example_id, split; ``topic``: example_id, negative_id, document_id (see ``merged_runs``); ``easy``:
    negative_id, document_id, split. A passage without a topic negative takes an easy one of its split, the i-th of
    either in hash order; easy negatives of documents that topic negatives come from are left out. Easy negatives are
    never used twice: a split with too few of them falls short.
    """
    named = passages.join(topic.select("example_id", "negative_id"), "example_id").withColumn("kind", F.lit("topic"))
    rest = stage(passages.join(topic.select("example_id"), "example_id", "left_anti"), "rest")
    free = stage(easy.join(topic.select("document_id").distinct(), "document_id", "left_anti").select("negative_id", "split"), "free")
    needed, there = (x.groupBy("split").agg(F.count("*").cast("int").alias(n)) for x, n in ((rest, "needed"), (free, "available")))
    short = needed.join(there, "split", "left").na.fill(0, ["available"]).where("available < needed").select("split", F.lit("easy").alias("source"), "needed", "available")
    fallback = zipped(rest, free, ["split"], T.rank_key(f"{namespace}-passage", "example_id"), T.rank_key(f"{namespace}-easy", "negative_id")).withColumn("kind", F.lit("easy"))
    columns = ["example_id", "split", "negative_id", "kind"]
    return _checked(named.select(columns).unionByName(fallback.select(columns)), [short], strict)
