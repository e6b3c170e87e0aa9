"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source gets a target number of words (see targets()). Its documents, ordered by a hash, fall
in blocks of like size; a pass over a source draws all its blocks in a permuted order, and a source
is passed over until its target is met: whole passes, then blocks of one more, the last of which is
cut in the order of its documents' hashes, to the word or to the nearest document. The draws of all
sources are dealt to the output shards by a binary tree: a node has a number of draws of each source, and its left
child gets half of them as an urn without replacement would give it, a multivariate-hypergeometric
variate, until each leaf, a shard, has its exact quota of each source. A shard takes its quota from the
source's sequence of draws, so shards are disjoint and together take each draw once. Within a shard, rows
are ordered by another hash.

All of it is DataFrame and SQL functions. Everything random is a hash with the seed, so reruns agree. Blocks
number at most about max_blocks and the number of sources, whatever the input's size. Documents meet the plans of
sources and blocks by broadcast where these are counted to have at most most_broadcast rows (some 200 bytes each),
so no text is shuffled; beyond, by shuffle, a source's documents spread over `salts` parts. Sources may be
many: a variate over more than FAN of them is drawn over groups first, then within groups, so no array is longer.

Defined results: a null text has no words; documents without words are not taken; a null source is
a source of its own, last in the order; a null id is like any other; rows alike in all columns are
taken like any others, and where the cut falls on them, as many of them are taken as it leaves; an empty table gives
an empty result; the input's columns are passed on first, in their order, and one whose name the
result needs gets underscores after its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backleaf.llm.common import beside, free_name, stage

WEIGHTS = (5, 2, 1)
#: The most entries of one array of counts in the tree, as a number of bits.
FAN_BITS = 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with `rank`: sources by code point, null last, from 0.

    Sorted by ranges; a row's rank is its place in its range after the rows of the ranges before, whose counts
    are as many as there are partitions.
    """
    at = stage(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = at.groupBy(part.alias("part")).count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return at.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at") - F.shiftleft("part", 33)).drop("at", "part", "before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3) -> DataFrame:
    """sizes (source, source_size, any others) with `rank`, `weight`, `target` (double) and `total`, a staged table.

    Sources by code point, null last, take the weights in turn; they share the sum of all sizes by weight, but none
    gets over most_repeats times its size. What those that stop leave goes to the others by weight, until none is
    above: a few rounds, of each of which the driver keeps two sums.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    out = stage(ranked(sizes).withColumn("weight", weight), "ranked")
    cap = F.col("source_size") * most_repeats
    total, open_weight = (x or 0 for x in out.agg(F.sum("source_size"), F.sum("weight")).first())
    rest, stops = total, F.lit(False)
    while open_weight:
        stops = F.col("weight") * F.lit(float(rest)) > cap * F.lit(float(open_weight))
        stopped, sharing = out.agg(F.sum(F.when(stops, cap).otherwise(0)), F.sum(F.when(stops, 0).otherwise(F.col("weight")))).first()
        if sharing == open_weight:
            break
        rest, open_weight = total - stopped, sharing
    share = F.col("weight") * F.lit(float(rest)) / F.lit(float(open_weight)) if open_weight else cap.cast("double")
    return out.withColumn("target", F.when(stops, cap.cast("double")).otherwise(share)).withColumn("total", F.lit(total).cast("long"))


def ln_factorial(n: str) -> str:
    """SQL for ln n!: exact up to 20, then Stirling's series (error below 1e-13)."""
    x = f"cast({n} as double)"
    return f"if({n} <= 20, ln(factorial(cast(least({n}, 20) as int))), {x} * ln({x}) - {x} + 0.5 * ln(2 * pi() * {x}) + 1 / (12 * {x}) - 1 / (360 * pow({x}, 3)) + 1 / (1260 * pow({x}, 5)))"


def hypergeometric(good: str, bad: str, draws: str, u: str) -> str:
    """SQL for how many of `draws` from good + bad are good, by inversion at u in (0, 1).

    The sum starts 9 standard deviations below the mean and ends as far above, outside which less
    than 1e-15 of the mass lies.
    """
    def ln_choose(n: str, k: str) -> str:
        return f"({ln_factorial(n)} - {ln_factorial(k)} - {ln_factorial(f'({n} - {k})')})"

    return f"""aggregate(array(named_struct('g', {good}, 'b', {bad}, 'd', {draws}, 'u', {u})), 0L, (none, q) ->
      aggregate(array(named_struct('mean', q.d * q.g / greatest(q.g + q.b, 1), 'sd',
          sqrt(q.d * (q.g / greatest(q.g + q.b, 1)) * (q.b / greatest(q.g + q.b, 1)) * (q.g + q.b - q.d) / greatest(q.g + q.b - 1, 1)))), 0L, (none2, m) ->
        aggregate(array(named_struct('a', greatest(0L, q.d - q.b, cast(floor(m.mean - 9 * m.sd) as bigint) - 2), 'z', least(q.g, q.d, cast(ceil(m.mean + 9 * m.sd) as bigint) + 2))), 0L, (none3, r) ->
          if(r.a >= r.z, r.z, aggregate(array(exp({ln_choose('q.g', 'r.a')} + {ln_choose('q.b', '(q.d - r.a)')} - {ln_choose('(q.g + q.b)', 'q.d')})), 0L, (none4, p0) ->
            aggregate(sequence(r.a, r.z - 1), named_struct('p', p0, 'sum', p0, 'x', r.a), (s, k) -> named_struct(
                'p', s.p * ((q.g - k) * cast(q.d - k as double)) / ((k + 1) * cast(q.b - q.d + k + 1 as double)),
                'sum', s.sum + s.p * ((q.g - k) * cast(q.d - k as double)) / ((k + 1) * cast(q.b - q.d + k + 1 as double)),
                'x', s.x + if(s.sum < q.u, 1L, 0L)), s -> s.x))))))"""


def halved(groups: DataFrame, depth: int, digit: int, seed: int) -> DataFrame:
    """(node, g, n, left) of rows (node, draws, of): of has (g, n) of each part, and left is how many of the node's draws fall to the part."""
    u = f"(cast(xxhash64({seed}, {depth}, {digit}, node, x.g) & 4503599627370495L as double) + 0.5) / 4503599627370496D"
    left = f"""aggregate(of, named_struct('rest', aggregate(of, 0L, (a, x) -> a + x.n), 'draws', draws, 'out', cast(array() as array<struct<g: bigint, n: bigint, left: bigint>>)),
      (s, x) -> aggregate(array({hypergeometric('x.n', '(s.rest - x.n)', 's.draws', u)}), s,
        (s2, k) -> named_struct('rest', s2.rest - x.n, 'draws', s2.draws - k, 'out', concat(s2.out, array(named_struct('g', x.g, 'n', x.n, 'left', k))))), s -> s.out)"""
    return groups.select("node", F.explode(F.expr(left)).alias("x")).select("node", "x.*")


def split(quotas: DataFrame, levels: int, sources: int, seed: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """(node, rank, n) of the 2 ** levels leaves: how many draws of a source a leaf has, where any.

    quotas: (rank, n), the draws of each source; ranks are below `sources`. Each level's draws go by half to the left
    child. Of many sources, groups of ranks share a node's draws first, then the groups within them, by fan_bits at a time.
    """
    digits = max(1, -(-max(sources - 1, 1).bit_length() // fan_bits))
    level = quotas.where("n > 0").select(F.lit(0).cast("long").alias("node"), F.col("rank").cast("long").alias("rank"), "n")
    for depth in range(levels):
        want = None
        for digit in reversed(range(digits)):
            sums = level.select("node", F.shiftright("rank", fan_bits * digit).alias("g"), "n")
            sums = sums.groupBy("node", "g").agg(F.sum("n").alias("n")) if digit else sums
            groups = sums.groupBy("node", F.shiftright("g", fan_bits).alias("above")).agg(F.array_sort(F.collect_list(F.struct("g", "n"))).alias("of"))
            if want is None:  # all parts of a node
                groups = groups.withColumn("draws", F.expr("aggregate(of, 0L, (a, x) -> a + x.n) div 2"))
            else:
                groups = groups.join(want, ["node", "above"])
            parts = halved(groups, depth, digit, seed)
            want = parts.select("node", F.col("g").alias("above"), F.col("left").alias("draws"))
        sides = F.expr("array(named_struct('node', 2 * node, 'n', left), named_struct('node', 2 * node + 1, 'n', n - left))")
        level = stage(parts.select(F.col("g").alias("rank"), F.explode(sides).alias("c")).select("c.node", "rank", "c.n").where("n > 0"), "split")
    return level


def plan(sized: DataFrame, weights: tuple[int, ...], most_repeats: int, shards: int, max_blocks: int, least_words: int, most_broadcast: int, salts: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (source, h, size): the sources' plan and the blocks' plan, both staged.

    Sources: source, rank, source_size, target, n_blocks. Blocks: rank, block, draws (of each draw of the block its
    pass, its shard, and whether it is the one cut), and of the block that is cut cut_at, the hash of its document
    there, and cut_left, the words that this one has left.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_source = targets(sizes, weights, most_repeats)
    per_block = F.greatest(F.lit(least_words), F.ceil(F.col("total") / max_blocks))
    by_source = by_source.withColumn("n_blocks", F.least("n_docs", F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_block))))
    words = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    by_source = stage(by_source.select("source", "rank", "source_size", "target", "n_blocks", passes.alias("passes"), (words - passes * F.col("source_size")).alias("rest")), "sources")
    sources = by_source.count()

    in_block = with_block(sized, by_source, sources <= most_broadcast, salts)
    blocks = in_block.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    drawn = blocks.where("words > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), "passes")))
    drawn = drawn.withColumn("turn", F.xxhash64(F.lit(seed), F.lit("turn"), "rank", "pass", "block"))
    # At most max_blocks rows of a source and pass.
    before = Window.partitionBy("rank", "pass").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("pass") == F.col("passes")
    left = F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0))
    drawn = drawn.withColumn("words_left", F.when(last, left)).where("words_left is null or words_left > 0")
    drawn = drawn.withColumn("limit", F.when(F.col("words_left") < F.col("words"), F.col("words_left")))
    drawn = stage(drawn.withColumn("j", F.row_number().over(Window.partitionBy("rank").orderBy("pass", "turn", "block")) - 1).select("rank", "block", "pass", "limit", "j"), "draws")

    # The document at which a cut falls: only rows of cut blocks are sorted, one block a source, and no text.
    cut = drawn.where("limit is not null").select("rank", "block", "limit")
    in_cut = in_block.join(F.broadcast(cut) if sources <= most_broadcast else cut, ["rank", "block"]).where("size > 0")
    so_far = Window.partitionBy("rank").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    runs = in_cut.groupBy("rank", "block", "limit", "h").agg(F.sum("size").alias("words")).withColumn("end", F.sum("words").over(so_far)).where("end - words < limit and end >= limit")
    at = runs.select("rank", "block", F.col("h").alias("cut_at"), F.expr("limit - (end - words)").alias("cut_left"))

    leaves = split(drawn.groupBy("rank").agg(F.count("*").alias("n")), (shards - 1).bit_length(), sources, seed)
    ends = leaves.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("q"))
    ends = ends.select("rank", F.expr("transform(sequence(1, size(q)), i -> struct(q[i - 1].node as node, aggregate(slice(q, 1, i), 0L, (a, x) -> a + x.n) as end))").alias("ends"))
    placed = drawn.join(ends, "rank").withColumn("shard", F.expr("cast(filter(ends, e -> e.end > j)[0].node as int)"))
    draw = F.struct("pass", "shard", F.col("limit").isNotNull().alias("is_cut"))
    by_block = placed.groupBy("rank", "block").agg(F.array_sort(F.collect_list(draw)).alias("block_draws"))
    return by_source, stage(by_block.join(at, ["rank", "block"], "left"), "blocks")


def with_block(rows: DataFrame, by_source: DataFrame, few: bool, salts: int) -> DataFrame:
    """rows (source, h and others) with their source's plan and `block`; by broadcast of few sources, else a source's rows meet its plan in `salts` parts."""
    of = by_source.withColumnRenamed("source", "plan_source")
    here = F.col("source").eqNullSafe(F.col("plan_source"))
    if few:
        joined = rows.join(F.broadcast(of), here)
    else:
        of = of.withColumn("plan_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.join(of, here & (F.pmod(F.shiftright("h", 40), F.lit(salts)) == F.col("plan_salt"))).drop("plan_salt")
    return joined.drop("plan_source").withColumn("block", F.pmod("h", "n_blocks"))


def mix(
    df: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most_repeats: int = 3,
    shards: int = 64,
    max_blocks: int = 65536,
    least_words: int = 1024,
    whole: bool = False,
    most_broadcast: int = 250_000,
    salts: int = 16,
    seed: int = 20,
) -> DataFrame:
    """df with `size`, `source_size`, `target` and `draws`, the times the mix takes a row.

    A draw has `pass` (from 0), `shard` (0 to shards - 1, a power of two), `words` (how many it takes: all, or the
    first of them at the cut; with `whole` all or none, whichever is nearer) and `place` (rows of a shard are in its
    order). least_words: the words that a block has at least, if its source does.
    """
    made = ("size", "source_size", "target", "draws")
    own = [f"c{i}" for i in range(len(df.columns))]
    names = beside(df.columns, made)
    rows = df.select(*[df[c].alias(n) for c, n in zip(df.columns, own)], df[source_col].alias("source"), F.xxhash64(F.lit(seed), *[df[c] for c in df.columns]).alias("h"))
    text = own[df.columns.index(text_col)]
    sized = stage(rows.select("source", "h", word_count(F.col(text)).alias("size")), "sizes")
    by_source, by_block = plan(sized, weights, most_repeats, shards, max_blocks, least_words, most_broadcast, salts, seed)
    rows = with_block(rows, by_source.drop("passes", "rest"), by_source.count() <= most_broadcast, salts)
    rows = rows.join(F.broadcast(by_block) if by_block.count() <= most_broadcast else by_block, ["rank", "block"], "left")

    def drawn(part: DataFrame, at_cut: str) -> DataFrame:
        """part with the words of each draw; at_cut: those of the draw that is cut."""
        part = part.withColumn("size", word_count(F.col(text)))
        draws = f"filter(transform(coalesce(block_draws, array()), d -> named_struct('pass', d.pass, 'shard', d.shard, 'words', if(d.is_cut, {at_cut}, size), 'place', xxhash64({seed}, 'place', d.shard, d.pass, h))), d -> d.words > 0)"
        return part.select(*[F.col(n).alias(c) for c, n in zip(names, own)], "size", "source_size", "target", F.expr(draws).alias("draws"))

    # Rows alike in all columns at the cut are counted and numbered; there is one such row a source, or its copies.
    on_cut = F.coalesce(F.col("h") == F.col("cut_at"), F.lit(False))
    copies = rows.where(on_cut)
    copies = copies.groupBy(*[c for c in copies.columns if c != "block_draws"]).agg(F.first("block_draws").alias("block_draws"), F.count("*").alias("copies"))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    left = "(cut_left - copy * size)"
    return drawn(rows.where(~on_cut), "if(h < cut_at, size, 0L)").unionByName(drawn(copies, f"if(2 * {left} >= size, size, 0L)" if whole else f"greatest(0L, least(size, {left}))"))


def drawn_rows(mixed: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """A row for each draw: the input's columns, the text cut to the words taken (and length_col made its length), shard and place."""
    own = mixed.columns[:-4]
    draw = free_name("draw", mixed.columns)
    rows = mixed.select("*", F.explode("draws").alias(draw))
    is_cut = F.col(f"{draw}.words") < F.col("size")
    # A word with the white space before it is one part.
    cut = F.array_join(F.slice(F.split(text_col, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.col(f"{draw}.words").cast("int")), "")
    changed = {text_col: F.when(is_cut, cut).otherwise(F.col(text_col))}
    if length_col:
        changed[length_col] = F.when(is_cut, F.char_length(cut).cast(mixed.schema[length_col].dataType)).otherwise(F.col(length_col))
    named = zip(own, beside(own, ("shard", "place")))
    return rows.select(*[changed.get(c, F.col(c)).alias(n) for c, n in named], F.col(f"{draw}.shard").alias("shard"), F.col(f"{draw}.place").alias("place"))


def write_shards(mixed: DataFrame, path: str, text_col: str = "text") -> None:
    """Writes drawn_rows() by shard, each in the order of its places; large shards take several files."""
    rows = drawn_rows(mixed, text_col)
    rows.repartitionByRange(F.col("shard"), F.col("place")).sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)
