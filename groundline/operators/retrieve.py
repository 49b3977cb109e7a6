"""Vector search as joins: exact, with a total order by distance and id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.errors import EmptyCollectionError, MissingCollectionError, RetrievalError
from groundline.functions import text as tx
from groundline.functions import vectors as vx
from groundline.operators import pivots
from groundline.operators.pivots import BLOCK_BYTES, SLACK, STRIP
from groundline.session import kept
from groundline.settings import DEFAULT, Settings

#: Pairs that are measured term by term at once.
PAIRS = 1 << 15


def open_index(spark, path: str, settings: Settings = DEFAULT, meta_path: str | None = None) -> DataFrame:
    """The index at a path; missing and empty ones have errors of their own, and so has one of another model.

    Its metadata stand at `meta_path`, or in index_meta beside it; an index without any is taken as it is.
    """
    from pyspark.errors import AnalysisException

    from groundline.operators.embed import assert_compatible

    try:
        index = spark.read.parquet(path)
    except AnalysisException as e:
        raise MissingCollectionError(f"there is no index at {path}") from e
    if index.isEmpty():
        raise EmptyCollectionError(f"the index at {path} has no rows")
    try:
        meta = spark.read.parquet(meta_path or f"{path.rstrip('/').rpartition('/')[0]}/index_meta")
    except AnalysisException:
        if meta_path is not None:
            raise
        return index
    assert_compatible(meta, settings)
    return index


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate for a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """With a hint to broadcast if the plan is estimated to be small; else it is shuffled as usual."""
    return F.broadcast(df) if size_in_bytes(df) <= settings.broadcast_bytes else df


def dealt_out(df: DataFrame) -> DataFrame:
    """For a join by question, whose sides both grow with the questions: it goes by the driver to no worker, however small its files are beside its rows."""
    return df.hint("merge")


def beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of one row each as one row."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def exact_products(a, b, i, j):
    """Products of rows i of a with rows j of b, summed term by term: the last digits hang on no matrix product's order."""
    import numpy as np

    parts = [(a[i[k : k + PAIRS]] * b[j[k : k + PAIRS]]).cumsum(axis=1)[:, -1] for k in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def numbered(*ids):
    """Ids of several frames as numbers in the order of the ids, and the ids of these numbers."""
    import numpy as np
    import pandas as pd

    codes, known = pd.factorize(np.concatenate([np.asarray(x) for x in ids]), sort=True)
    return *np.split(codes, np.cumsum([len(x) for x in ids])[:-1]), known


def block_of(rows) -> tuple:
    """Ids and vectors, as doubles, of a frame."""
    import numpy as np

    return rows["_i" if "_i" in rows else "_q"].to_numpy(), np.stack(rows["_v"].to_numpy()).astype(float)


def ranked_block(items: tuple, asked: tuple, k: int, same: bool, exclude_self: bool, limits=None):
    """The k nearest items of a block for each question, by strips of one product of matrices: places of question and item, and distance.

    Products only choose; what they leave, ties at the limit with it, is measured again term by term.  With `limits`, products that a question's
    items have to reach, only those are looked at.  Ids and groups are numbers; items of another group are left out, but for a question of none (-1).
    """
    import numpy as np

    ids, vectors, groups = items
    q_ids, q_vectors, q_groups = asked
    found = []
    for a in range(0, len(q_ids), STRIP):
        own = slice(a, a + STRIP)
        near = q_vectors[own] @ vectors.T
        if same:
            near[(q_groups[own, None] != groups[None, :]) & (q_groups[own, None] >= 0)] = -np.inf
        if exclude_self:
            near[q_ids[own, None] == ids[None, :]] = -np.inf
        if limits is not None:
            least = limits[own, None]
        else:
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None] if near.shape[1] > k else -np.inf
        i, j = np.nonzero((near >= least - SLACK) & (near > -np.inf))
        far = 1.0 - exact_products(q_vectors[own], vectors, i, j)
        order = np.lexsort((ids[j], far, i))
        i, j, far = i[order], j[order], far[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((a + i[best], j[best], far[best]))
    return [np.concatenate(x) for x in zip(*found)]


def framed(rows: list[tuple], *names: str):
    """Rows as a pandas frame of plain objects, whose types Spark's schema settles."""
    import pandas as pd

    return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})


def block_number(table: DataFrame, id_col: str, block_bytes: int) -> int:
    """Into how many blocks of so many bytes the vectors of a table go, as doubles; the table is counted, so it should be one that is written."""
    first = table.select(F.size("embedding").alias("n")).first()
    return 1 if first is None else max(1, -(-table.select(id_col).count() * 8 * max(1, first["n"]) // block_bytes))


def top_k(queries: DataFrame, index: DataFrame, k: int = DEFAULT.top_k, query_id: str = "query_id", item_id: str = "chunk_id", filter_col: str | None = None, blocks: int | None = None, exclude_self: bool = False, batches: int | None = None) -> DataFrame:
    """The k nearest items of each query: query_id, rank, item_id, distance.

    Queries are the stated set and go against all items in blocks.  Both sides are dealt by hashes to as many parts as bound a part's bytes
    (unless told); each batch of queries meets each block in one task as two matrices, keeps the k best of each query there, and the few
    winners of all blocks are ranked again.  So a task holds one batch and one block, however many rows there are, and no pair of query
    and item is ever a row.  With `filter_col`, a query whose value is not null meets items of that value alone.
    """
    import pandas as pd

    blocks = blocks or block_number(index, item_id, BLOCK_BYTES)
    batches = batches or block_number(queries, query_id, BLOCK_BYTES)
    kinds = dict(queries.dtypes)[query_id], dict(index.dtypes)[item_id]
    group = (lambda c: F.col(c).cast("string")) if filter_col else (lambda c: F.lit(None).cast("string"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col(query_id).alias("_q"), F.col("embedding").cast("array<double>").alias("_v"), group(filter_col).alias("_g"), dealt(query_id, batches).alias("_a"), every(blocks).alias("_b"))
    items = index.select(F.col(item_id).alias("_i"), F.col("embedding").cast("array<double>").alias("_v"), group(filter_col).alias("_g"), dealt(item_id, blocks).alias("_b"), every(batches).alias("_a"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return framed([], "_q", "_i", "_d")
        (q_ids, q_vectors), (ids, vectors) = block_of(left), block_of(right)
        q_groups, groups, _ = numbered(left["_g"], right["_g"])
        # questions and items may have ids of different types
        order, _ = numbered(ids)
        alike = dict(zip(ids.tolist(), order.tolist(), strict=True))
        asked = pd.Series(q_ids.tolist(), dtype=object).map(lambda q: alike.get(q, -1)).to_numpy(int)
        i, j, far = ranked_block((order, vectors, groups), (asked, q_vectors, q_groups), k, filter_col is not None, exclude_self)
        return pd.DataFrame({"_q": q_ids[i], "_i": ids[j], "_d": far})

    found = q.groupBy("_a", "_b").cogroup(items.groupBy("_a", "_b")).applyInPandas(run, f"_q {kinds[0]}, _i {kinds[1]}, _d double")
    return best_of(found, k, query_id, item_id)


def best_of(found: DataFrame, k: int, query_id: str, item_id: str) -> DataFrame:
    """The k nearest of what all blocks found (_q, _i, _d)."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy("_d", "_i"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("_q").alias(query_id), "rank", F.col("_i").alias(item_id), F.col("_d").alias("distance"))


def merged_top_k(queries: DataFrame, index: DataFrame, k: int, form: str, query_id: str = "query_id", item_id: str = "chunk_id", **options) -> DataFrame:
    """The k nearest items of each query that is asked in several forms: an item counts once, by the form that it is nearest to."""
    kind = dict(queries.dtypes)[query_id]
    rows = queries.withColumn("_asked", F.struct(F.col(query_id).alias("q"), F.sha1(F.col(form).cast("string")).alias("f")))
    found = top_k(rows.withColumn("_asked", F.to_json("_asked")), index, k, "_asked", item_id, **options)
    found = found.select(F.from_json("_asked", f"q {kind}, f string")["q"].alias("_q"), F.col(item_id).alias("_i"), "distance")
    return best_of(found.groupBy("_q", "_i").agg(F.min("distance").alias("_d")), k, query_id, item_id)


def nearest_one(index: DataFrame, vector: list[float], k: int = DEFAULT.top_k, item_id: str = "chunk_id", where: Column | None = None) -> DataFrame:
    """The k nearest items of one vector: a projection and a bounded sort."""
    rows = index if where is None else index.filter(where)
    scored = rows.select(item_id, vx.distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])).alias("distance"))
    return scored.orderBy("distance", item_id).limit(k).withColumn("rank", F.row_number().over(Window.orderBy("distance", item_id)))


def retrieve(questions: DataFrame, index: DataFrame, embed, settings: Settings = DEFAULT, auto_detect: bool = True, used: list[DataFrame] | None = None) -> DataFrame:
    """Hits of each question (query_id, question, and scheme if given), by the vector of its expanded text.

    The vectors of the questions are written once, to a table that is added to `used`.  With `settings.dual_query` the question without its scheme's name is searched as well, and the nearest hits of both are kept.
    """
    from groundline.operators import rewrite

    known = [s for s, _ in settings.aliases]
    given = F.col("scheme") if "scheme" in questions.columns else F.lit(None).cast("string")
    scheme = F.when(given.isNotNull() & ~given.isin(known), F.raise_error(F.concat(F.lit("unknown scheme "), given))).otherwise(F.coalesce(given, rewrite.detect_scheme(F.col("question"), settings)) if auto_detect else given)
    asked = questions.select("query_id", scheme.alias("scheme"), rewrite.expand(F.col("question"), settings).alias("expanded_query"))
    if settings.dual_query:
        plain = questions.select("query_id", rewrite.without_scheme(F.col("question"), settings).alias("_other"))
        forms = asked.join(plain, "query_id").withColumn("_form", F.explode(F.array_distinct(F.array("expanded_query", rewrite.expand(F.col("_other"), settings)))))
        vectors = kept(embed(forms.select("query_id", "scheme", "_form"), "_form"), "vectors")
        found = merged_top_k(vectors, index, settings.top_k, "_form", filter_col="scheme")
    else:
        vectors = kept(embed(asked, "expanded_query"), "vectors")
        found = top_k(vectors, index, settings.top_k, filter_col="scheme")
    if used is not None:
        used.append(vectors)
    return hits(found, index).join(dealt_out(asked.select("query_id", F.col("scheme").alias("filter"), "expanded_query")), "query_id")


def hits(found: DataFrame, index: DataFrame) -> DataFrame:
    """Found items with their texts and metadata; what is missing is an empty text, the path is split again."""
    texts = ("text", "section", "scheme", "scheme_name", "category", "source_url", "fetched_at")
    path = F.col("heading_path") if dict(index.dtypes)["heading_path"].startswith("array") else F.split(F.coalesce("heading_path", F.lit("")), " > ")
    items = index.select("chunk_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in texts], F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda p: F.trim(p) != "").alias("heading_path"))
    return found.join(items, "chunk_id")


def gate(queries: DataFrame, found: DataFrame, limit: float = DEFAULT.max_distance, aggregation: str = DEFAULT.gate_aggregation, query_id: str = "query_id") -> DataFrame:
    """query_id, gate_score and passes_gate for every query; the limit itself passes, and without hits none does."""
    if aggregation not in ("min", "max"):
        raise RetrievalError(f"unknown aggregation {aggregation!r}")
    scores = found.groupBy(query_id).agg((F.min if aggregation == "min" else F.max)("distance").alias("gate_score"))
    return queries.select(query_id).join(dealt_out(scores), query_id, "left").withColumn("passes_gate", F.coalesce(F.col("gate_score") <= limit, F.lit(False)))


def tiles(left: DataFrame, right: DataFrame, run: Callable, ddl: str) -> DataFrame:
    """run(key, left, right) for each pair of blocks (_a, _c): two frames of bounded size."""
    return left.groupBy("_a", "_c").cogroup(right.groupBy("_a", "_c")).applyInPandas(run, ddl)


def all_neighbours(index: DataFrame, n: int = 3, item_id: str = "chunk_id", pivot_count: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The n nearest other items of each item; distances are at least 0.

    First each item meets those of its own block; the n-th best there is a limit that no block has to be met for whose bound is below it, so only
    the others follow.  A task holds two blocks; a vector is sent once for each block, however many pivots there are.  Results are those of comparing all with all.
    """
    import pandas as pd

    dealt = pivots.deal(index, item_id, pivot_count, block_bytes)

    def own(block: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        ids, vectors = block_of(block)
        codes, _ = numbered(ids)
        i, j, far = ranked_block((codes, vectors, None), (codes, vectors, None), n, False, True)
        cuts = np.searchsorted(i, np.arange(1, len(ids)))
        near, apart = np.split(ids[j], cuts), np.split(far, cuts)
        return block.assign(_limit=[1.0 - d[-1] if len(d) == n else -np.inf for d in apart], _near=near, _far=apart)

    def others(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return framed([], "_q", "_i", "_d")
        (q_ids, q_vectors), (ids, vectors) = block_of(left), block_of(right)
        asked, codes, _ = numbered(q_ids, ids)
        i, j, far = ranked_block((codes, vectors, None), (asked, q_vectors, None), n, False, True, left["_limit"].to_numpy(float))
        return pd.DataFrame({"_q": q_ids[i], "_i": ids[j], "_d": far})

    columns = f"_i {dealt.kind}, _v {dealt.vector}, _p int, _s int, _b int"
    first = kept(dealt.items.groupBy("_b").applyInPandas(own, f"{columns}, _limit double, _near array<{dealt.kind}>, _far array<double>"), "own")
    met = pivots.reached(first, dealt).select("_i", "_v", "_limit", F.col("_b").alias("_a"), F.array_remove(pivots.wanted(dealt), F.col("_b")).alias("_c"))
    left = kept(met.filter(F.size("_c") > 0), "met").withColumn("_c", F.explode("_c"))
    # a row for each block, with the blocks whose items ask for it
    asking = kept(left.groupBy("_c").agg(F.collect_set("_a").alias("_a")), "asking")
    right = dealt.items.withColumnRenamed("_b", "_c").join(sized(asking), "_c").select("_i", "_v", F.explode("_a").alias("_a"), "_c")
    rest = tiles(left, right, others, f"_q {dealt.kind}, _i {dealt.kind}, _d double")
    within = first.select(F.col("_i").alias("_q"), F.inline(F.arrays_zip("_near", "_far"))).toDF("_q", "_i", "_d")
    best = best_of(within.unionByName(rest), n, "query_id", item_id)
    return best.select("query_id", "rank", F.col(item_id).alias("neighbour"), F.greatest(F.lit(0.0), "distance").alias("distance"))


def similar_links(index: DataFrame, similarity: float, item_id: str = "chunk_id", pivot_count: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every item the number of other items above a similarity, and the least id among them and itself.

    Items meet only the blocks with a pivot whose bound reaches the similarity, and those items of theirs for which the same holds, as
    matrices, each pair of blocks in one task; pairs of items are never rows, and a vector is sent once for each block, however many pivots there are.
    """
    import pandas as pd

    dealt = pivots.deal(index, item_id, pivot_count, block_bytes)
    met = pivots.reached(dealt.items.withColumn("_limit", F.lit(float(similarity))), dealt)
    met = kept(met.select("_i", "_v", "_b", pivots.wanted(dealt).alias("_with")), "met")
    # a pair of blocks meets once
    later, earlier = F.filter("_with", lambda k: k >= F.col("_b")), F.filter("_with", lambda k: k <= F.col("_b"))
    left = met.select("_i", "_v", F.col("_b").alias("_a"), F.explode(later).alias("_c"))
    right = met.select("_i", "_v", F.explode(earlier).alias("_a"), F.col("_b").alias("_c"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(left) or not len(right):
            return framed([], "_i", "_n", "_least")
        (ids, a), (others, b) = block_of(left), block_of(right)
        own, codes, known = numbered(ids, others)
        count = [np.zeros(len(ids), int), np.zeros(len(others), int)]
        least = [np.full(len(x), len(known)) for x in (ids, others)]
        for at in range(0, len(ids), STRIP):
            near = a[at : at + STRIP] @ b.T
            i, j = np.nonzero(near > similarity - SLACK)
            product, i = near[i, j], i + at
            close = np.flatnonzero(product < similarity + SLACK)
            product[close] = exact_products(a, b, i[close], j[close])
            hit = (product > similarity) & (own[i] != codes[j])
            i, j = i[hit], j[hit]
            for side, x, y in ((0, i, codes[j]), (1, j, own[i])):
                count[side] += np.bincount(x, minlength=len(count[side]))
                np.minimum.at(least[side], x, y)
        # a block with itself has each pair on both sides
        sides = ((ids, 0),) if key[0] == key[1] else ((ids, 0), (others, 1))
        out = [pd.DataFrame({"_i": x[count[k] > 0], "_n": count[k][count[k] > 0], "_least": known[least[k][count[k] > 0]]}) for x, k in sides]
        return pd.concat(out)

    found = tiles(left, right, run, f"_i {dealt.kind}, _n long, _least {dealt.kind}")
    counted = found.groupBy("_i").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"))
    rows = dealt.items.select("_i").join(counted, "_i", "left")
    return rows.select(F.col("_i").alias(item_id), F.coalesce("_n", F.lit(0)).alias("n_links"), F.least("_i", F.coalesce("_least", "_i")).alias("least_link"))


def greedy_dedupe(found: DataFrame, index: DataFrame, similarity: float = DEFAULT.dedupe_similarity, query_id: str = "query_id", item_id: str = "chunk_id") -> DataFrame:
    """Hits of each query without those too similar to a better one that itself stays (the k hits of a query are folded in order)."""
    rows = found.join(index.select(item_id, F.col("embedding").alias("_v")), item_id)
    listed = rows.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("rank", F.col(item_id), "distance", "_v"))).alias("_hits"))
    none = F.filter("_hits", lambda h: F.lit(False))
    kept = F.aggregate("_hits", none, lambda out, h: F.when(F.exists(out, lambda o: vx.dot(o["_v"], h["_v"]) > similarity), out).otherwise(F.concat(out, F.array(h))))
    return listed.select(query_id, F.explode(kept).alias("h")).select(query_id, F.col("h.rank").alias("rank"), F.col(f"h.{item_id}").alias(item_id), F.col("h.distance").alias("distance"))


def render(hit_columns: dict[str, str] | None = None) -> Column:
    """A hit as a block of context."""
    path = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")).otherwise(F.col("section"))
    label = F.when(F.col("scheme_name") != "", F.col("scheme_name")).otherwise(F.col("scheme"))
    return F.concat(F.lit("["), label, F.lit(" | "), path, F.lit("]\nSource: "), F.col("source_url"), F.lit("\n\n"), F.col("text"))


def within_budget(rows: DataFrame, budget: int = DEFAULT.context_budget, query_id: str = "query_id", tokens: str = "tokens") -> DataFrame:
    """The best-ranked rows of each query while their tokens together fit; the first always stays."""
    best = Window.partitionBy(query_id).orderBy("rank")
    total = F.sum(tokens).over(best.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"_total": total, "_n": F.row_number().over(best)}).filter((F.col("_total") <= budget) | (F.col("_n") == 1)).drop("_total", "_n")


def context(found: DataFrame, index: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Blocks of context for each query: near duplicates suppressed, then cut to the token budget."""
    kept = greedy_dedupe(found, index, settings.dedupe_similarity)
    rows = kept.select("query_id", "rank", "chunk_id").join(dealt_out(found.drop("rank")), ["query_id", "chunk_id"]).withColumn("block", render())
    return within_budget(rows.withColumn("tokens", tx.count_tokens(F.col("block"))), settings.context_budget)


def norm_stats(index: DataFrame, scheme: str = "scheme", section: str = "section", tokens: str = "n_tokens") -> DataFrame:
    """Rows and norms, and as far as the columns are there: numbers of schemes and sections, sum and range of tokens."""
    length, have = vx.norm(F.col("embedding")), set(index.columns)
    more = [F.count_distinct(c).alias(n) for c, n in ((scheme, "n_schemes"), (section, "n_sections")) if c in have]
    if tokens in have:
        more += [F.sum(tokens).cast("long").alias("tokens"), F.min(tokens).alias("min_tokens"), F.max(tokens).alias("max_tokens")]
    return index.agg(F.count("*").alias("n_rows"), F.round(F.min(length), 6).alias("min_norm"), F.round(F.max(length), 6).alias("max_norm"), *more)


def probe_report(questions: DataFrame, found: DataFrame, settings: Settings = DEFAULT, chars: int = 160) -> DataFrame:
    """What a search did, as lines of text: query_id, line_no and line, for every question, with hits or without.

    questions: query_id and question; found: their hits, as `retrieve` gives them (with filter and expanded_query where there are hits).
    """
    from groundline.operators import rewrite

    scores = gate(questions, found, settings.max_distance, settings.gate_aggregation)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    hit = F.array(
        F.format_string("%d. d=%.4f %s [%s] %s", F.col("rank"), F.col("distance"), F.col("chunk_id"), text("scheme"), text("section")),
        F.concat(F.lit("   "), text("source_url")),
        F.concat(F.lit("   "), F.substring(tx.collapse(F.col("text")), 1, chars)),
    )
    listed = found.groupBy("query_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", hit.alias("lines")))), lambda h: h["lines"])).alias("_hits"), F.max("filter").alias("filter"))
    rows = questions.select("query_id", "question").join(scores, "query_id").join(listed, "query_id", "left")
    named = rewrite.detect_scheme(F.col("question"), settings)
    measured = F.when(F.col("gate_score").isNull(), "n/a").otherwise(F.format_string("%.4f", "gate_score"))
    kind = "best" if settings.gate_aggregation == "min" else "worst"
    head = F.array(
        F.concat(F.lit("question: "), text("question")),
        F.concat(F.lit("expanded: "), rewrite.expand(F.col("question"), settings)),
        F.concat(F.lit("scheme filter: "), F.coalesce("filter", F.when(F.col("_hits").isNull(), named), F.lit("none"))),
        F.concat(F.lit("gate: "), F.when(F.col("passes_gate"), "PASS").otherwise("FAIL"), F.lit(f" ({kind}_distance="), measured, F.lit(f" limit={settings.max_distance} aggregation={settings.gate_aggregation})")),
        F.lit(""),
    )
    lines = F.concat(head, F.coalesce("_hits", F.array(F.lit("no hits"))))
    return rows.select("query_id", F.posexplode(lines).alias("line_no", "line"))
