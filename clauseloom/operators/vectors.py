"""Vectors, centroids and similarity tables.

A vector column is ``vec array<double>``. Pair tables are equi joins on the meeting (and speaker);
norms and histograms are computed once per vector before the join. Where only the best partners are
wanted, vectors are compared in blocks (``nearest_by_metric``) and pairs never become rows; a meeting
with most of the rows is dealt out in pieces (``split_join``). ``dim`` (vector length) makes
the arithmetic compile into generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import vectors as V
from clauseloom.operators.blocks import met_in_blocks, similar_pairs
from clauseloom.operators.dialog import block_of
from clauseloom.operators.ordered import row_index, running, split_join, top_rows, with_totals
from clauseloom.session import cut_lineage, ship

# Metric names in report order.
METRICS = ("cos_similarity", "kl_divergence", "chebyshev_distance", "euclidean_distance", "manhattan_distance")


def vectors_by_id(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    return rows.join(vectors, ["meeting", "id"])


def attach_by_row(rows: DataFrame, *columns: DataFrame) -> DataFrame:
    """Attach columns of other tables to the rows with the same (meeting, id); never by position."""
    out = rows
    for extra in columns:
        out = out.join(extra, ["meeting", "id"])
    return out


def labelled_points(points: DataFrame, labels: DataFrame, speakers: DataFrame) -> DataFrame:
    """Points with their cluster and speaker, noise (-1) dropped."""
    return attach_by_row(points, labels.filter(F.col("cluster") != -1), speakers)


def dedupe_text(clustered: DataFrame) -> DataFrame:
    """Lowest id per distinct utterance of a cluster. Copies collapse before the shuffle."""
    return clustered.groupBy("meeting", "cluster", "utterance").agg(F.min("id").alias("id"))


def mean_vector(rows: DataFrame, keys: Sequence[str], divisor: int | None = None, dim: int | None = None) -> DataFrame:
    """Element-wise mean of ``vec`` per key, or the sum over a fixed divisor. Sums are per position
    and combined before the shuffle, so a key costs one row per position and task; with ``dim``, the
    length of all vectors, one row per task."""
    if dim is not None:
        whole = rows.filter("vec is not null").withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.lit(f"a vector without exactly {dim} numbers")).cast("array<double>")))
        sums = [(F.avg if divisor is None else F.sum)(F.col("vec")[i]).alias(f"__x{i}") for i in range(dim)]
        mean = [F.col(f"__x{i}") if divisor is None else F.col(f"__x{i}") / divisor for i in range(dim)]
        return whole.groupBy(*keys).agg(*sums).select(*keys, F.array(*mean).alias("vec"))
    total = F.avg("x") if divisor is None else F.sum("x") / divisor
    cells = rows.select(*keys, F.posexplode("vec").alias("pos", "x")).groupBy(*keys, "pos").agg(total.alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"])
    return cells.groupBy(*keys).agg(ordered.alias("vec"))


def centroid(clustered: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean vector per cluster over its distinct utterances."""
    return mean_vector(vectors_by_id(dedupe_text(clustered), vectors), ["meeting", "cluster"])


def cosine_to_centroid(clustered: DataFrame, vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """Distinct clauses of each cluster with their cosine to the cluster's centroid."""
    # Finding the distinct texts shuffles them, so it is done once.
    members = cut_lineage(vectors_by_id(dedupe_text(clustered), vectors))
    middle = mean_vector(members, ["meeting", "cluster"], dim=dim).withColumnRenamed("vec", "com")
    score = V.cosine_similarity(F.col("vec"), F.col("com"), dim)
    return members.join(middle, ["meeting", "cluster"]).select(
        "meeting", "id", "cluster", "utterance", score.alias("cos_similarity_to_com")
    )


def above_cluster_mean(central: DataFrame, digits: int | None = None) -> DataFrame:
    """Clauses strictly above their cluster's mean cosine; a cluster of one clause disappears.

    The sum of a mean depends on the order of its terms in the last bits; ``digits`` rounds both
    sides of the comparison so that a repeated run decides alike."""
    # Written, so that cosines are made once for the means and the rows.
    with_mean = with_totals(cut_lineage(central), ["meeting", "cluster"], {"mean": F.avg("cos_similarity_to_com")})
    score, mean = F.col("cos_similarity_to_com"), F.col("mean")
    if digits is not None:
        score, mean = F.round(score, digits), F.round(mean, digits)
    return with_mean.filter(score > mean).drop("mean")


# --- pairs ------------------------------------------------------------------------------------


def prepared(rows: DataFrame, side: str, dim: int | None = None, with_histogram: bool = True) -> DataFrame:
    """Rename ``vec`` for one side of a pair and add what need not be computed per pair."""
    extra = {f"{side}_norm": V.norm(F.col("vec"), dim)}
    if with_histogram:
        extra[f"{side}_hist"] = V.histogram(F.col("vec"))
    return rows.withColumns(extra).withColumnRenamed("vec", f"{side}_vec")


def pair_cosine(dim: int | None) -> Column:
    return V.cosine_from(V.dot(F.col("a_vec"), F.col("b_vec"), dim), F.col("a_norm"), F.col("b_norm"))


def title_clause_metrics(titles: DataFrame, clauses: DataFrame, dim: int | None = None, block: int = 65536) -> DataFrame:
    """Every title of a meeting with every digest clause of it: five metrics and a sequential id
    (title by title). Titles are told apart by ``title_id``, so equal titles stay separate.

    titles: meeting, title_id, title, vec; clauses: meeting, clause_id, clause, vec."""
    t = row_index(titles, ["meeting"], block_of("title_id", block), ["title_id"], "title_no")
    c = row_index(clauses, ["meeting"], block_of("clause_id", block), ["clause_id"], "clause_no")
    sizes = clauses.groupBy("meeting").agg(F.count("*").alias("per_title"))
    left, right = prepared(t, "a", dim).join(sizes, "meeting"), prepared(c, "b", dim)
    va, vb = F.col("a_vec"), F.col("b_vec")
    return split_join(left, right, ["meeting"]).select(
        "meeting",
        ((F.col("title_no") - 1) * F.col("per_title") + F.col("clause_no") - 1).alias("id"),
        "title_id",
        "title",
        "clause_id",
        "clause",
        pair_cosine(dim).alias("cos_similarity"),
        V.kl_from_histograms(F.col("a_hist"), F.col("b_hist")).alias("kl_divergence"),
        V.chebyshev_distance(va, vb, dim).alias("chebyshev_distance"),
        V.euclidean_distance(va, vb, dim).alias("euclidean_distance"),
        V.manhattan_distance(va, vb, dim).alias("manhattan_distance"),
    )


#: Numbers of compared vectors that are held at once.
COMPARED = 1 << 18


def _added(terms: np.ndarray) -> np.ndarray:
    """The sum over the first axis, one term after the other, so that it is alike in any block."""
    total = terms[0].copy()
    for term in terms[1:]:
        total += term
    return total


def _histograms(flat: pa.Array, vecs: np.ndarray) -> np.ndarray:
    """``functions.vectors.histogram`` of each row of ``vecs``, whose numbers, with their nulls, are ``flat``."""
    undefined = np.isnan(vecs) & flat.is_valid().to_numpy(zero_copy_only=False).reshape(vecs.shape)
    low, high = np.where(np.isnan(vecs), np.inf, vecs).min(axis=1), np.where(np.isnan(vecs), -np.inf, vecs).max(axis=1)
    constant = low == high
    with np.errstate(invalid="ignore", over="ignore"):
        start = np.where(constant, low - 0.5, low)
        step = (np.where(constant, high + 0.5, high) - start) / V.BINS
        edge = start[:, None] + step[:, None] * np.arange(V.BINS + 1)
    inside = vecs[:, None, :] >= edge[:, :-1, None]
    inside[:, :-1] &= vecs[:, None, :] < edge[:, 1:-1, None]
    count = inside.sum(axis=2)
    # Spark takes an undefined number for the greatest: then no bin has edges, and the last has such numbers.
    odd = undefined.any(axis=1)
    count[odd] = 0
    count[odd, -1] = undefined[odd].sum(axis=1)
    return (count + V.EPSILON) / vecs.shape[1]


def _least(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, key) of the n least finite keys of each row; on a tie the first place."""
    rows = np.arange(len(key))
    if key.shape[1] <= 64 or n > 8:
        best = np.argsort(key, axis=1, kind="stable")[:, :n]
        found = np.take_along_axis(key, best, axis=1)
    else:
        key, picked = key.copy(), []
        for _ in range(n):
            place = key.argmin(axis=1)
            picked.append((place, key[rows, place]))
            key[rows, place] = np.inf
        best, found = (np.stack(x, axis=1) for x in zip(*picked, strict=True))
    fits = np.isfinite(found)
    return np.repeat(rows, best.shape[1])[fits.ravel()], best[fits], found[fits]


def nearest_by_metric(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, n: int, metrics: Sequence[str] = METRICS, digits: int | None = None, skip_same: bool = False, from_right: bool = False
) -> DataFrame:
    """(keys, left_id, metric, rank, right_id, value): the n best rows of the right side for each row of
    the left and each metric, among those with equal keys. Ties go to the smaller id.

    Both sides: keys, their id, vec; ids are whole numbers, and a key's vectors have one length. Rows
    without a vector take no part. Pairs are compared in blocks as arrays, and a block gives each row
    n per metric: no pair becomes a row. A cosine with a zero vector is null and comes last.
    ``skip_same`` leaves out distances of exactly 0; ``from_right`` takes the divergence of the right
    side's histogram from the left one's, instead of the left's from the right's."""

    ship(left.sparkSession)

    def side(rows: DataFrame, name: str) -> DataFrame:
        return cut_lineage(rows.filter("vec is not null").select(*keys, F.col(name).cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")))

    def work(one: pa.Table, two: pa.Table) -> dict:
        two = two.take(pa.array(np.argsort(two.column("id").to_numpy(), kind="stable")))
        flat, i, j = [t.column("vec").combine_chunks().flatten() for t in (one, two)], one.column("id").to_numpy(), two.column("id").to_numpy()
        a, b = (np.array(f, float).reshape(t.num_rows, -1) for f, t in zip(flat, (one, two), strict=True))
        if METRICS[0] in metrics:
            norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
            cosine = np.divide(a @ b.T, norms, out=np.full(norms.shape, np.nan), where=norms != 0)
        if METRICS[1] in metrics:
            x, y = (np.ascontiguousarray(_histograms(f, v).T) for f, v in zip(flat, (a, b), strict=True))
        columns_a, columns_b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        out: list[tuple] = []
        step = max(1, COMPARED // max(1, b.size))
        for lo in range(0, len(a), step):
            part = slice(lo, lo + step)
            if any(m in metrics for m in METRICS[2:]):
                apart = columns_a[:, part, None] - columns_b[:, None, :]
                np.abs(apart, out=apart)
            for at, metric in enumerate(metrics):
                if metric == METRICS[0]:
                    value = cosine[part]
                elif metric == METRICS[1]:
                    p, q = x[:, part, None], y[:, None, :]
                    p, q = (q, p) if from_right else (p, q)
                    value = _added(p * np.log(p / q))
                elif metric == METRICS[2]:
                    value = apart.max(axis=0)
                else:
                    value = np.sqrt(_added(apart**2)) if metric == METRICS[3] else _added(apart)
                value = value if digits is None else np.round(value, digits)
                key = np.where(np.isnan(value), np.finfo(float).max, -value if metric == METRICS[0] else value)
                if skip_same and metric != METRICS[0]:
                    key[value == 0] = np.inf
                row, best, keys_ = _least(key, n)
                out.append((i[part][row], np.full(len(row), at, np.int32), j[best], value[row, best], keys_))
        found = [np.concatenate([o[k] for o in out]) for k in range(5)]
        return {"l": found[0], "at": found[1], "r": found[2], "value": pa.array(found[3], mask=np.isnan(found[3])), "sort_key": found[4]}

    found = met_in_blocks(side(left, left_id), side(right, right_id), keys, "id", work, "l bigint, at int, r bigint, value double, sort_key double")
    best = top_rows(found, [*keys, "l", "at"], [F.col("sort_key"), F.col("r")], n)
    name = F.element_at(F.array(*map(F.lit, metrics)), F.col("at") + 1)
    return best.select(*keys, F.col("l").alias(left_id), name.alias("metric"), "rank", F.col("r").alias(right_id), "value")


def long_metrics(metrics: DataFrame) -> DataFrame:
    """One row per pair and metric; ``sort_key`` is ascending from best to worst."""
    keep = [c for c in metrics.columns if c not in METRICS]
    out = metrics.unpivot(keep, list(METRICS), "metric", "value")
    return out.withColumn("sort_key", F.when(F.col("metric") == METRICS[0], -F.col("value")).otherwise(F.col("value")))


def topk_by_metric(metrics: DataFrame, n: int = 5, digits: int | None = None) -> DataFrame:
    """The n best clauses per title and metric. A distance of exactly 0 is a self match and left
    out; a cosine is never left out."""
    long = long_metrics(metrics)
    if digits is not None:
        long = long.withColumns({"sort_key": F.round("sort_key", digits), "value": F.round("value", digits)})
    kept = long.filter((F.col("metric") == METRICS[0]) | (F.col("value") != 0.0))
    return top_rows(kept, ["meeting", "title_id", "metric"], [F.col("sort_key").asc_nulls_last(), F.col("clause_id")], n).drop("sort_key")


def clause_in_topk(truth: DataFrame, top: DataFrame) -> DataFrame:
    """Per true (title_id, clause) and metric: 1 if the clause's text is among the title's best."""
    asked = truth.withColumn("metric", F.explode(F.array(*[F.lit(m) for m in METRICS])))
    best = top.select("meeting", "title_id", "metric", "clause").distinct().withColumn("hit", F.lit(1).cast("long"))
    return asked.join(best, ["meeting", "title_id", "metric", "clause"], "left").na.fill(0, ["hit"])


def metric_report(hits: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    return hits.groupBy(*keys).agg(
        F.count("*").alias("total"), F.sum("hit").alias("matched"), F.avg(F.col("hit").cast("double")).alias("rate")
    )


def title_top_clauses(titles: DataFrame, clauses: DataFrame, n: int = 5, digits: int | None = None) -> DataFrame:
    """Per title the n clauses of highest cosine and the n of lowest divergence, from all clauses
    of the meeting: (meeting, title_id, metric, rank, id, value, speaker_name)."""
    best = nearest_by_metric(titles, clauses, ["meeting"], "title_id", "id", n, METRICS[:2], digits, from_right=True)
    return best.join(clauses.select("meeting", "id", "speaker_name"), ["meeting", "id"])


def speaker_in_topk(rows: DataFrame, top: DataFrame) -> DataFrame:
    """Per digest clause (meeting, title_id, id, speaker_name) and metric: 1 if its speaker is
    among the speakers of the title's best clauses."""
    asked = rows.withColumn("metric", F.explode(F.array(F.lit(METRICS[0]), F.lit(METRICS[1]))))
    best = top.select("meeting", "title_id", "metric", "speaker_name").distinct().withColumn("hit", F.lit(1).cast("long"))
    return asked.join(best, ["meeting", "title_id", "metric", "speaker_name"], "left").na.fill(0, ["hit"])


def nearest_same_speaker(digest_clauses: DataFrame, clauses: DataFrame, digits: int | None = None) -> DataFrame:
    """Per digest clause the same speaker's minutes clause of highest cosine (lowest id on a tie),
    null where the speaker never spoke.

    Both sides: meeting, id, speaker_name, vec."""
    where = ["meeting", "speaker_name"]
    best = nearest_by_metric(digest_clauses, clauses.withColumnRenamed("id", "near_id"), where, "id", "near_id", 1, METRICS[:1], digits)
    found = best.select(*where, "id", "near_id", F.col("value").alias("cos_similarity"))
    return digest_clauses.select("meeting", "id", "speaker_name").join(found, [*where, "id"], "left").select("meeting", "id", "speaker_name", "near_id", "cos_similarity")


def topk_mean_vector(digest_clauses: DataFrame, clauses: DataFrame, n: int = 3, divide_by: str = "n", digits: int | None = None, dim: int | None = None) -> DataFrame:
    """Mean of the same speaker's n most similar vectors, which are joined to the best pairs alone.
    ``divide_by='n'`` divides by n even where fewer exist, ``'count'`` by their number. ``dim``: the
    length of all vectors, if it is known."""
    where = ["meeting", "speaker_name"]
    near = clauses.withColumnRenamed("id", "near_id")
    best = nearest_by_metric(digest_clauses, near, where, "id", "near_id", n, METRICS[:1], digits)
    full = best.join(near.select(*where, "near_id", "vec"), [*where, "near_id"]).select("meeting", "id", "vec")
    return mean_vector(full, ["meeting", "id"], n if divide_by == "n" else None, dim)


def speaker_pair_relation(digest_clauses: DataFrame, carried: Sequence[str] = ("clause",)) -> DataFrame:
    """Every pair of clauses by two speakers (the smaller name first) of a meeting, label 1 where
    their titles are equal. digest_clauses: meeting, id, title, speaker_name, and the columns that
    both sides bring along as ``policy_`` and ``reply_`` columns."""
    a = digest_clauses.select("meeting", *[F.col(c).alias(f"policy_{c}") for c in ("id", "title", "speaker_name", *carried)])
    b = digest_clauses.select("meeting", *[F.col(c).alias(f"reply_{c}") for c in ("id", "title", "speaker_name", *carried)])
    same = F.col("policy_title").eqNullSafe(F.col("reply_title"))
    return (
        split_join(a, b, ["meeting"])
        .filter(F.col("policy_speaker_name") < F.col("reply_speaker_name"))
        .select(
            "meeting",
            "policy_id",
            F.col("policy_speaker_name").alias("policy_speaker"),
            *[f"policy_{c}" for c in carried],
            "reply_id",
            F.col("reply_speaker_name").alias("reply_speaker"),
            *[f"reply_{c}" for c in carried],
            same.cast("long").alias("label"),
        )
    )


def pair_similarity(pairs: DataFrame, vectors: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """Cosine of the policy and the reply vector for each row of the pair relation. Without ``vectors``
    the pairs bring along their ``policy_vec``, ``policy_norm``, ``reply_vec`` and ``reply_norm``, and
    none of them is shuffled."""
    if vectors is None:
        own = {f"{role}_{c}": f"{side}_{c}" for role, side in (("policy", "a"), ("reply", "b")) for c in ("vec", "norm")}
        kept = [c for c in pairs.columns if c not in own]
        return pairs.withColumnsRenamed(own).select(*kept, pair_cosine(dim).alias("cos_similarity"))
    a = prepared(vectors.withColumnRenamed("id", "policy_id"), "a", dim, False)
    b = prepared(vectors.withColumnRenamed("id", "reply_id"), "b", dim, False)
    both = pairs.join(a, ["meeting", "policy_id"]).join(b, ["meeting", "reply_id"])
    return both.select(*pairs.columns, pair_cosine(dim).alias("cos_similarity"))


def triplet_distances(triples: DataFrame, vectors: DataFrame, dim: int | None = None, digits: int | None = None) -> DataFrame:
    """Per triple of ids and metric: 1 where the positive is nearer to the anchor than the other.
    ``digits`` rounds both sides, so that equal distances compare as equal."""

    def r(x: Column) -> Column:
        return x if digits is None else F.round(x, digits)

    out = triples
    for role in ("anchor", "positive", "other"):
        out = out.join(vectors.select("meeting", F.col("id").alias(role), F.col("vec").alias(f"{role}_vec")), ["meeting", role])
    a, p, o = (F.col(f"{role}_vec") for role in ("anchor", "positive", "other"))
    tests = {
        "cosine": r(V.cosine_similarity(a, p, dim)) > r(V.cosine_similarity(a, o, dim)),
        "manhattan": r(V.manhattan_distance(a, p, dim)) < r(V.manhattan_distance(a, o, dim)),
        "euclidean": r(V.euclidean_distance(a, p, dim)) < r(V.euclidean_distance(a, o, dim)),
    }
    return out.select("meeting", "anchor", "positive", "other", *[F.coalesce(t.cast("double"), F.lit(0.0)).alias(n) for n, t in tests.items()])


def triplet_accuracy(triples: DataFrame, vectors: DataFrame, dim: int | None = None, digits: int | None = None) -> DataFrame:
    """Share of triples decided rightly by each metric, and the best of the shares."""
    near = triplet_distances(triples, vectors, dim, digits)
    names = ("cosine", "manhattan", "euclidean")
    shares = near.agg(F.count("*").alias("triples"), *[F.avg(n).alias(f"accuracy_{n}") for n in names])
    return shares.withColumn("accuracy_max", F.greatest(*[f"accuracy_{n}" for n in names]))


def mined_pairs(sentences: DataFrame, min_score: float = -1.0, digits: int = 6) -> DataFrame:
    """Pairs of a meeting's sentences (id1 < id2) with a cosine of at least ``min_score``, by an exact
    similarity join: pairs below it are never produced as rows, and in large meetings only vectors near
    each other are compared."""
    return similar_pairs(sentences, ["meeting"], min_score, digits)


def known_pair_scores(known: DataFrame, sentences: DataFrame, dim: int | None = None, digits: int = 6) -> DataFrame:
    """Distinct known pairs with their cosine."""
    pairs = known.select("meeting", F.least("id1", "id2").alias("policy_id"), F.greatest("id1", "id2").alias("reply_id"))
    scored = pair_similarity(pairs.filter("policy_id <> reply_id").distinct(), sentences, dim)
    return scored.withColumn("score", F.round("cos_similarity", digits))


def paraphrase_mining(mined: DataFrame, known: DataFrame, cells: int = 1024) -> DataFrame:
    """Best F1 with its precision, recall and score, and average precision, when mined pairs
    (..., score) are taken from the highest score down; ``known`` holds the scores of the known
    pairs, which come first among equal scores.

    Mined pairs are only counted per score, inside the stage that makes them; ranking is a running
    count over blocks of scores, and only known pairs are numbered one by one."""
    known = cut_lineage(known)
    steps = cut_lineage(
        mined.groupBy("score")
        .agg(F.count("*").alias("pairs"))
        .join(known.groupBy("score").agg(F.count("*").alias("right")), "score", "left")
        .na.fill(0, ["right"])
    )
    down = -F.col("score")
    ranked = running(steps, [], [F.floor(down * cells)], [down], sums={"extracted": F.col("pairs"), "correct": F.col("right")})
    size = known.agg(F.count("*")).scalar()
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("right"))).alias("i")
    hits = ranked.filter(F.col("right") > 0).withColumn("known", size).select("*", each)
    correct = F.col("correct") - F.col("right") + F.col("i")
    scored = hits.select(
        "score",
        "known",
        (correct / (F.col("extracted") - F.col("pairs") + F.col("i"))).alias("precision"),
        (correct / F.col("known")).alias("recall"),
    ).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    best = F.max(F.struct("f1", "score", "precision", "recall")).alias("best")
    return scored.agg(best, (F.sum("precision") / F.max("known")).alias("average_precision")).select(
        F.col("best.f1").alias("f1"),
        F.col("best.precision").alias("precision"),
        F.col("best.recall").alias("recall"),
        F.col("best.score").alias("score"),
        "average_precision",
    )
