"""Sampling of pages that differ (the first and last page of every file, then the farthest page again and again), and
pairs of similar pages.

Edge cases: a page without text has its kind as its only piece; repeated pages are equal candidates, of which the first in
order is taken; pages of unknown kind count as not blank; an empty table has an empty sample and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import fingerprint
from ..storage import materialise, number_rows, release, ship, small_or_not

#: Pages of a sample where there are no more files, and the weight of a page's distance within its file.
SAMPLE_PAGES, SPREAD = 64, 0.05
#: Best candidates of a scan that the driver chooses among, before the next scan.
POOL = 64


def _nearer(picks: list[tuple], file: str, page: str):
    """Lower every candidate's distance and gap by the picks: (file, page, pieces)."""
    known = [(f, p, frozenset(g)) for f, p, g in picks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                grams = frozenset(r["grams"])
                for f, p, g in known:
                    shared = len(grams & g)
                    whole = len(grams) + len(g) - shared
                    r["d"] = min(r["d"], 1 - shared / whole if whole else 0.0)
                    if r[file] == f:
                        gap = abs(r[page] - p) / max(1, r["n"])
                        r["gap"] = gap if r["gap"] is None else min(r["gap"], gap)
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return run


def representative(pages: DataFrame, most: int = SAMPLE_PAGES, file: str = "filename", page: str = "page", text: str = "text", kind: str = "kind") -> DataFrame:
    """filename, page and pick (from 1) of up to max(most, files) pages.

    A pick is the page whose smallest distance to the picks so far is largest (plus a small share for its distance in
    pages within its file), the first in order among equals. Where there are `most` files or more, their first pages are
    the sample, and nothing passes the driver. Else every scan of the candidates lowers their distances by the last picks
    and hands the POOL best to the driver, which picks among them as long as one of them is surely the best of all:
    distances only fall, so no other page can pass the last of the pool. The driver holds at most POOL + most pages.
    """
    spark = pages.sparkSession
    ship(spark)
    ok = pages.filter(F.coalesce(F.col(kind) != "blank", F.lit(True)))
    prints = materialise(ok.select(file, page, fingerprint(F.col(text), F.col(kind)).alias("grams")).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    ends = materialise(prints.groupBy(file).agg(F.count("*").alias("n"), F.min(F.struct(page, "row")).alias("first"), F.max(F.struct(page, (-F.col("row")).alias("row"))).alias("last")), "file-ends")
    totals = ends.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    files, total = int(totals[0]), int(totals[1])
    budget = max(most, files)
    if total <= budget:
        return number_rows(prints.select(file, page), "pick", [file, page]).withColumn("pick", F.col("pick").cast("int"))
    if files >= most:
        return number_rows(ends.select(file, F.col(f"first.{page}").alias(page)), "pick", [file, page]).withColumn("pick", F.col("pick").cast("int"))
    seeds = ends.select("first.row", F.lit(0).alias("turn")).union(ends.filter("first.row <> -last.row").select((-F.col("last.row")).alias("row"), F.lit(1)))
    picked = [(r[file], r[page], r["grams"], r["row"]) for r in prints.join(seeds, "row").orderBy("turn", file, page).limit(budget).collect()]
    state = prints.join(small_or_not(ends.select(F.col(file).alias("__f"), "n")), F.col(file) == F.col("__f")).drop("__f").withColumn("d", F.lit(2.0)).withColumn("gap", F.lit(None).cast("double"))
    fresh, before = list(picked), prints
    while len(picked) < budget:
        lowered = state.mapInArrow(_nearer([p[:3] for p in fresh], file, page), state.schema)
        state = materialise(lowered.filter(~F.col("row").isin([p[3] for p in fresh])), "distances")  # at most POOL + most numbers
        release(before)
        before = state
        score = F.col("d") + SPREAD * F.coalesce("gap", F.lit(1.0))
        pool = [r.asDict() for r in state.orderBy(F.desc(score), file, page, "row").limit(POOL).collect()]
        limit, fresh = len(pool) == POOL, []
        place = lambda r: (-(r["d"] + SPREAD * (1.0 if r["gap"] is None else r["gap"])), r[file], r[page], r["row"])
        bound = place(pool[-1]) if pool else None  # all other pages stand behind this
        while pool and len(picked) < budget:
            best = min(pool, key=place)
            if limit and place(best) > bound:
                break
            pool.remove(best)
            fresh.append((best[file], best[page], best["grams"], best["row"]))
            picked.append(fresh[-1])
            grams = frozenset(best["grams"])
            for r in pool:
                own = frozenset(r["grams"])
                r["d"] = min(r["d"], 1 - len(own & grams) / len(own | grams))
                if r[file] == best[file]:
                    gap = abs(r[page] - best[page]) / max(1, r["n"])
                    r["gap"] = gap if r["gap"] is None else min(r["gap"], gap)
        if not fresh:
            break
    kinds = dict(prints.dtypes)
    return spark.createDataFrame([(p[0], p[1], i) for i, p in enumerate(picked, 1)], f"{file} {kinds[file]}, {page} {kinds[page]}, pick int")


def classes(pages: DataFrame, id_col: str, grams: str = "grams") -> DataFrame:
    """id, class_id: pages of equal pieces are one class, named by its smallest id."""
    rows = pages.select(F.col(id_col).alias("id"), F.sha2(F.array_join(F.array_sort(grams), "\x1f"), 256).alias("h"))
    return rows.join(rows.groupBy("h").agg(F.min("id").alias("class_id")), "h").select("id", "class_id")


def similar_pairs(pages: DataFrame, id_col: str, grams: str = "grams", least: float = 0.5) -> DataFrame:
    """(a, b, shared, similarity) of all pairs a < b of classes (see `classes`) with a Jaccard similarity of `least` or
    more.

    Classes meet through their rarest pieces only. In the order of how many classes hold a piece, a class of n pieces
    that is similar enough to one of at least its size shares one of its first n - ceil(2 * least / (1 + least) * n) + 1
    pieces with the first n - ceil(least * n) + 1 of the other, so a piece that stands everywhere (as the kind does) joins
    next to nothing. Sizes that differ too much do not meet. Candidates are then compared whole.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(grams).alias("grams"), F.sha2(F.array_join(F.array_sort(grams), "\x1f"), 256).alias("h"))
    known = materialise(rows.groupBy("h").agg(F.min_by("grams", "id").alias("grams"), F.min("id").alias("id")).select("id", "grams", F.size("grams").alias("n")), "classes")
    pieces = known.select("id", "n", F.explode("grams").alias("g"))
    counted = pieces.groupBy("g").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "g")  # a page has at most MAX_GRAMS pieces
    placed = pieces.join(counted, "g").withColumn("at", F.row_number().over(order)).filter("df > 1")
    upto = lambda share: F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1
    rare = materialise(placed.filter(F.col("at") <= upto(least)).withColumn("short", F.col("at") <= upto(2 * least / (1 + least))).select("id", "n", "g", "short"), "rare-pieces")
    smaller = rare.filter("short").select(F.col("id").alias("s"), F.col("n").alias("ns"), "g")
    meets = (F.struct("ns", "s") < F.struct("n", "id")) & (F.col("ns") >= F.lit(least) * F.col("n") - 1e-9)
    candidates = materialise(rare.join(smaller, "g").filter(meets).select(F.least("id", "s").alias("a"), F.greatest("id", "s").alias("b")).distinct(), "similar-candidates")
    left = known.select(F.col("id").alias("a"), F.col("grams").alias("ga"), F.col("n").alias("na"))
    right = known.select(F.col("id").alias("b"), F.col("grams").alias("gb"), F.col("n").alias("nb"))
    both = candidates.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("ga", "gb")).cast("long"))
    found = both.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("similarity"))
    return found.filter((F.col("shared") > 0) & (F.col("similarity") >= least))
