"""An approximate index: inverted lists of a coarse quantiser, with product codes beside the vectors.

Centres and code books are fitted on a bounded sample; every row is dealt to the list of its nearest centre and gets a code of one byte
for each few components of what is left after the centre.  The table lies in Parquet, partitioned by list.  A search reads the codes of the
nearest lists, a sixteenth of the vectors' bytes, keeps the best candidates of each question, and measures only those by their vectors,
term by term.  The exact search over everything is `retrieve.top_k`.

Defined results: rows whose vector is null are refused when the lists are written; rows of one id in one list count once; questions whose filter matches
nothing, or with no list that has rows, have no hits; an empty table makes lists that cannot be opened (EmptyCollectionError).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundline.errors import EmptyCollectionError, MissingCollectionError, RetrievalError
from groundline.functions import vectors as vx
from groundline.operators import pivots, retrieve

MOST_LISTS = 1024
#: Components that share a byte of code, and the values of a byte.
PART, CODES = 4, 256
#: Rows of a list that one task compares with a batch of so many questions.
SLICE_ROWS, BATCH_ROWS = 65_536, 1024


@dataclass
class Quantiser:
    """Centres of the lists, and for each part of the vector the values that its codes stand for; both of bounded size."""

    centres: np.ndarray
    books: np.ndarray

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Vectors as parts, the last one filled up with zeros."""
        m, _, w = self.books.shape
        out = np.zeros((len(x), m * w))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, w)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each vector."""
        chosen = pivots.nearest_centre(x, self.centres)
        rest = self.parts(x - self.centres[chosen])
        return chosen, np.stack([pivots.nearest_centre(rest[:, k], b) for k, b in enumerate(self.books)], axis=1).astype(np.uint8)


@dataclass
class Lists:
    table: DataFrame
    quantiser: Quantiser
    #: Rows of each list.
    rows: np.ndarray


def fit(index: DataFrame, item_id: str = "chunk_id", lists: int | None = None, part: int = PART, sample_rows: int = pivots.SAMPLE_ROWS) -> Quantiser:
    """Centres (the root of the number of rows unless told, at most MOST_LISTS) and code books from a sample of at most `sample_rows` rows."""
    n = index.select(item_id).count()
    taken = pivots.sample(index, item_id, sample_rows, n)
    if not len(taken):
        raise EmptyCollectionError("there are no vectors to fit lists on")
    lists = min(MOST_LISTS, lists or max(1, math.isqrt(n)))
    out = Quantiser(pivots.lloyd(taken, lists), np.zeros((-(-taken.shape[1] // part), 0, part)))
    rest = out.parts(taken - out.centres[pivots.nearest_centre(taken, out.centres)])
    books = [pivots.lloyd(rest[:, k], CODES) for k in range(rest.shape[1])]
    # a part with fewer distinct values than codes repeats its last one
    most = max(map(len, books))
    out.books = np.stack([np.concatenate([b, np.repeat(b[-1:], most - len(b), axis=0)]) for b in books])
    return out


def write(index: DataFrame, path: str, quantiser: Quantiser, item_id: str = "chunk_id", filter_col: str | None = None) -> None:
    """All rows by list (id, embedding, code and the text of a column to filter by), and the quantiser beside them."""
    import pandas as pd

    spark, kind = index.sparkSession, dict(index.dtypes)[item_id]
    ok = F.when(F.size("embedding") == quantiser.centres.shape[1], F.col("embedding")).otherwise(F.raise_error(F.lit("a vector has the wrong length")))
    group = F.col(filter_col).cast("string") if filter_col else F.lit(None).cast("string")
    rows = index.select(F.col(item_id).alias("item"), ok.cast("array<float>").alias("embedding"), group.alias("kind"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                chosen, codes = quantiser.encode(np.stack(b["embedding"].to_numpy()).astype(float))
                yield b.assign(code=[c.tobytes() for c in codes], list=chosen)

    coded = rows.mapInPandas(run, f"item {kind}, embedding array<float>, kind string, code binary, list int")
    # lists are gathered into few files, and one that holds much is cut up again
    coded.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    sizes = {r["list"]: r["count"] for r in spark.read.parquet(f"{path}/lists").groupBy("list").count().collect()}
    centres = [(k, c.tolist(), sizes.get(k, 0)) for k, c in enumerate(quantiser.centres)]
    spark.createDataFrame(centres, "list int, centre array<double>, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    books = [(k, c, v.tolist()) for k, b in enumerate(quantiser.books) for c, v in enumerate(b)]
    spark.createDataFrame(books, "part int, code int, value array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")


def open_lists(spark, path: str) -> Lists:
    """Lists as written; missing and empty ones have errors of their own."""
    from pyspark.errors import AnalysisException

    try:
        centres = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
        books = spark.read.parquet(f"{path}/books").orderBy("part", "code").collect()
        table = spark.read.parquet(f"{path}/lists")
    except AnalysisException as e:
        raise MissingCollectionError(f"there are no lists at {path}") from e
    rows = np.array([r["rows"] for r in centres])
    if not rows.sum():
        raise EmptyCollectionError(f"the lists at {path} have no rows")
    m = 1 + max(r["part"] for r in books)
    values = np.array([r["value"] for r in books])
    return Lists(table, Quantiser(np.array([r["centre"] for r in centres]), values.reshape(m, -1, values.shape[1])), rows)


def probed(queries: DataFrame, opened: Lists, probes: int, kind: str) -> DataFrame:
    """A row for each question (_q, _v, _g) and each of its nearest lists that have rows (_l, and the centre's product _e)."""
    import pandas as pd

    centres, have = opened.quantiser.centres, np.flatnonzero(opened.rows)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = centres[have]
        half = 0.5 * (known * known).sum(axis=1)
        for b in batches:
            if len(b):
                near = np.stack(b["_v"].to_numpy()).astype(float) @ known.T
                best = np.argsort(half[None, :] - near, axis=1, kind="stable")[:, :probes]
                yield b.assign(_l=list(have[best].astype(np.int32)), _e=list(np.take_along_axis(near, best, axis=1)))

    vector = dict(queries.dtypes)["_v"]
    # a question's lists stand in its row until they are taken apart outside Python, where no vector is repeated for a whole batch
    rows = queries.mapInPandas(run, f"_q {kind}, _v {vector}, _g string, _l array<int>, _e array<double>")
    return rows.select("_q", "_v", "_g", F.explode(F.arrays_zip("_l", "_e")).alias("_x")).select("_q", "_v", "_g", "_x._l", "_x._e")


def search(queries: DataFrame, opened: Lists, k: int = 5, probes: int = 8, refine: int = 8, query_id: str = "query_id", item_id: str = "chunk_id", filter_col: str | None = None, exclude_self: bool = False) -> DataFrame:
    """query_id, rank, item_id and distance of the nearest items found, and how many codes and vectors each question was compared with.

    The `probes` nearest lists are looked at, and the best `refine` times k candidates by code are measured exactly.
    """
    import pandas as pd

    if k < 1 or probes < 1 or refine < 1:
        raise RetrievalError("a search takes one hit, one list and one candidate for each hit at least")
    kinds = dict(queries.dtypes)[query_id], dict(opened.table.dtypes)["item"]
    group = F.col(filter_col).cast("string") if filter_col else F.lit(None).cast("string")
    vector = "array<float>" if dict(queries.dtypes)["embedding"] == "array<float>" else "array<double>"
    asked = queries.select(F.col(query_id).alias("_q"), F.col("embedding").cast(vector).alias("_v"), group.alias("_g"))
    slices = F.element_at(F.array(*[F.lit(int(n)) for n in np.maximum(1, -(-opened.rows // SLICE_ROWS))]), F.col("_l") + 1)
    batches = max(1, -(-asked.count() // BATCH_ROWS))
    left = probed(asked, opened, probes, kinds[0]).withColumns({"_a": F.pmod(F.xxhash64("_q"), F.lit(batches)).cast("int"), "_s": F.explode(F.sequence(F.lit(0), slices - 1))})
    items = opened.table.select(F.col("item").alias("_i"), "code", F.col("kind").alias("_k"), F.col("list").alias("_l"))
    items = items.withColumns({"_s": F.pmod(F.xxhash64("_i"), slices).cast("int"), "_a": F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))})
    quantiser, most = opened.quantiser, refine * k

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("_i", kind="stable")
            ids, kinds_of = right["_i"].to_numpy(object), right["_k"].to_numpy(object)
            codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(ids), -1)
            for r in left.itertuples(index=False):
                values = np.einsum("mcw,mw->mc", quantiser.books, quantiser.parts(np.asarray(r[1], float)[None])[0])
                score = r[4] + sum(values[m, codes[:, m]] for m in range(codes.shape[1]))
                if filter_col and r[2] is not None:
                    score = np.where(kinds_of == r[2], score, -np.inf)
                if exclude_self:
                    score = np.where(ids == r[0], -np.inf, score)
                best = np.argsort(-score, kind="stable")[:most]
                best = best[score[best] > -np.inf]
                out += [(r[0], ids[j], int(key[0]), float(score[j]), len(ids) if n == 0 else 0) for n, j in enumerate(best)]
        return retrieve.framed(out, "_q", "_i", "_l", "_e", "_n")

    by = ("_l", "_s", "_a")
    found = left.groupBy(*by).cogroup(items.groupBy(*by)).applyInPandas(run, f"_q {kinds[0]}, _i {kinds[1]}, _l int, _e double, _n long")
    all_of = Window.partitionBy("_q")
    chosen = found.withColumns({"codes_read": F.sum("_n").over(all_of), "_r": F.row_number().over(all_of.orderBy(F.col("_e").desc(), "_i"))}).filter(F.col("_r") <= most)
    vectors = opened.table.select(F.col("item").alias("_i"), F.col("list").alias("_l"), F.col("embedding").alias("_w")).dropDuplicates(["_i", "_l"])
    near = chosen.join(vectors, ["_i", "_l"]).join(asked.select("_q", "_v"), "_q").select("_q", "_i", "codes_read", vx.distance(F.col("_v"), F.col("_w")).alias("_d"))
    ranked = near.withColumns({"vectors_read": F.count("*").over(all_of), "rank": F.row_number().over(all_of.orderBy("_d", "_i"))}).filter(F.col("rank") <= k)
    return ranked.select(F.col("_q").alias(query_id), "rank", F.col("_i").alias(item_id), F.col("_d").alias("distance"), "codes_read", "vectors_read")


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", item_id: str = "chunk_id") -> DataFrame:
    """For each question of the exact search how many of its nearest items were found, of how many."""
    hits = found.select(query_id, item_id).withColumn("_hit", F.lit(1))
    return exact.join(hits, [query_id, item_id], "left").groupBy(query_id).agg(F.count("_hit").alias("found"), F.count("*").alias("nearest"))
