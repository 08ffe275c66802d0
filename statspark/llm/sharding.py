"""Shards by balanced label propagation under equal row quotas.

Rows start in an even, hashed deal. In each round, every group of linked rows
names the open shard that holds most of it, and its other members ask to move
there. A shard admits as many as it has unlinked rows to give back, and unlinked
rows fill the places that become free. So all shards keep their exact row
counts in every round, and cut links only become fewer. A group larger than a shard fills
one shard after the other.

Groups that the rounds leave in more shards than they need are settled at last: their
rows and the unlinked ones are pooled, and the groups are laid into the shards' pooled places, largest
first. If that still cuts a group that fits in a shard, all groups are pooled where this cuts fewer.

Group sizes (fewer than the root of twice the rows are distinct) and per-shard totals (at most n_shards**2 rows) are the only thing that the driver sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

N_SHARDS = 24
MAX_ROUNDS = 12
#: Rows that a ranking task orders at once.
BUCKET_ROWS = 20_000


def gapless(df: DataFrame, keys: list[str], unique: str, n_rows: int, out: str) -> DataFrame:
    """Adds gapless numbers from 0 within ``keys``, in a fixed hashed order of the unique long column.

    Rows are numbered in buckets of about BUCKET_ROWS, and each bucket starts after the
    rows of those before; so no task orders a whole key.
    """
    n_buckets = max(1, -(-n_rows // BUCKET_ROWS))
    b = F.pmod(F.xxhash64(unique), F.lit(n_buckets)).cast("int")
    held = df.withColumn("__b", b)
    sizes = held.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(F.xxhash64(unique), unique)) - 1
    on = F.col("__b") == F.col("__c")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    ranked = held.withColumn("__w", within).join(starts, on)
    return ranked.withColumn(out, (F.col("__start") + F.col("__w")).cast("long")).select(*df.columns, out)


def _admit(asked: dict[tuple[int, int], int], spare: dict[int, int], n_shards: int) -> tuple[dict[tuple[int, int], int], list[tuple[int, int, int]]]:
    """Admitted moves by (from, to), and moves of unlinked rows (from, to, count) that make up for them."""
    wanted = [sum(n for (_, j), n in asked.items() if j == k) for k in range(n_shards)]
    left = [min(spare.get(k, 0), wanted[k]) for k in range(n_shards)]
    admitted: dict[tuple[int, int], int] = {}
    for (i, j), n in sorted(asked.items()):
        part = min(left[j], -(-n * min(spare.get(j, 0), wanted[j]) // wanted[j]), n)
        if part:
            admitted[i, j] = part
            left[j] -= part
    net = [sum(n for (_, j), n in admitted.items() if j == k) - sum(n for (i, _), n in admitted.items() if i == k) for k in range(n_shards)]
    give, take, plan = [[k, n] for k, n in enumerate(net) if n > 0], [[k, -n] for k, n in enumerate(net) if n < 0], []
    while give and take:
        n = min(give[0][1], take[0][1])
        plan.append((give[0][0], take[0][0], n))
        for side in (give, take):
            side[0][1] -= n
            if not side[0][1]:
                side.pop(0)
    return admitted, plan


def _lay(sizes: dict[int, int], rooms: dict[int, int], quota: int) -> tuple[list[tuple[int, int, int, int, int, int]], dict[int, int], int]:
    """Places of groups by size and number, largest first: (size, group from, to, member from, to, shard), the rooms left, and needless cuts.

    Only a group for which no shard has room is cut, over the largest rooms.
    """
    rooms, steps, cuts = dict(rooms), [], 0
    for size, many in sorted(sizes.items(), reverse=True):
        g = 0
        while g < many:
            k = max(rooms, key=lambda x: (rooms[x], -x))
            if fit := min(many - g, rooms[k] // size):
                steps.append((size, g, g + fit, 0, size, k))
                rooms[k] -= fit * size
                g += fit
                continue
            at, parts = 0, 0
            while at < size:
                k = max(rooms, key=lambda x: (rooms[x], -x))
                part = min(rooms[k], size - at)
                steps.append((size, g, g + 1, at, at + part, k))
                rooms[k] -= part
                at, parts = at + part, parts + 1
            cuts += parts - -(-size // quota)
            g += 1
    return steps, rooms, cuts


def settle(state: DataFrame, n: int) -> DataFrame:
    """Joins the groups that lie in more shards than they need; all shards keep their counts."""
    quotas = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    if not quotas:
        return state
    quota = max(quotas.values())
    held = state.filter("grp IS NOT NULL").groupBy("grp", "shard").agg(F.count("*").alias("n"), F.min("rid").alias("gid"))
    groups = held.groupBy("grp").agg(F.sum("n").alias("n"), F.min("gid").alias("gid"), F.count("*").alias("c"))
    groups = store.table(groups.select(F.col("grp").alias("g"), "gid", F.col("n").alias("size"), (F.col("c") > F.ceil(F.col("n") / quota)).alias("split")), "groups")
    hist = groups.groupBy("size", "split").agg(F.count("*").alias("n")).collect()
    some, every = {r["size"]: r["n"] for r in hist if r["split"]}, {}
    for r in hist:
        every[r["size"]] = every.get(r["size"], 0) + r["n"]
    if not some:
        store.drop(groups)
        return state
    pool = groups.filter("split")
    member = state.join(pool, F.col("grp") == F.col("g"), "left").withColumn("in", F.col("gid").isNotNull() | F.col("grp").isNull())
    rooms = quotas | {k: 0 for k in quotas} | {r["shard"]: r["n"] for r in member.filter("in").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    steps, left, cuts = _lay(some, rooms, quota)
    if cuts:
        whole = _lay(every, quotas, quota)
        if whole[2] < cuts:
            (steps, left, _), pool = whole, groups
            member = state.join(pool, F.col("grp") == F.col("g"), "left").withColumn("in", F.lit(True))
    spark = state.sparkSession
    numbered = store.table(gapless(pool.select("g", "gid", "size"), ["size"], "gid", n, "num"), "groups")
    mine = state.join(numbered, F.col("grp") == F.col("g")).select("rid", "grp", "shard", "gid", "size", "num")
    ranked = gapless(mine, ["gid"], "rid", n, "rank")
    moves = spark.createDataFrame(steps, "z long, glo long, ghi long, mlo long, mhi long, dest int")
    on = (F.col("size") == F.col("z")) & (F.col("num") >= F.col("glo")) & (F.col("num") < F.col("ghi")) & (F.col("rank") >= F.col("mlo")) & (F.col("rank") < F.col("mhi"))
    out = ranked.join(F.broadcast(moves), on).select("rid", "grp", F.col("dest").alias("shard"))
    fill, at = [], 0
    for k, m in left.items():
        fill.append((at, at + m, k))
        at += m
    free = gapless(state.filter("grp IS NULL").select("rid", "grp").withColumn("__all", F.lit(0)), ["__all"], "rid", n, "rank")
    places = spark.createDataFrame(fill, "lo long, hi long, dest int")
    out = out.unionByName(free.join(F.broadcast(places), (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("rid", "grp", F.col("dest").alias("shard")))
    new = store.table(out.unionByName(member.filter(~F.col("in")).select("rid", "grp", "shard")), "shards")
    for old in (state, groups, numbered):
        store.drop(old)
    return new


def propagate(rows: DataFrame, n_shards: int = N_SHARDS, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, int]:
    """Adds ``shard`` to a written table of rows (rid: unique long; grp: group of linked rows, null if unlinked)."""
    n = rows.count()
    dealt = gapless(rows.select("rid", "grp").withColumn("__all", F.lit(0)), ["__all"], "rid", n, "pos")
    sizes = rows.filter("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("grp").alias("g"))
    linked = dealt.join(sizes, dealt.grp == sizes.g, "left").select("rid", F.col("g").alias("grp"), F.pmod("pos", F.lit(n_shards)).cast("int").alias("shard"))
    state = store.table(linked, "shards")
    for _ in range(max_rounds):
        spare = {r["shard"]: r["n"] for r in state.filter("grp IS NULL").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        if not spare:
            break
        held = state.filter("grp IS NOT NULL").groupBy("grp", "shard").agg(F.count("*").alias("n"))
        is_open = F.col("shard").isin(list(spare))
        best = held.filter(is_open).groupBy("grp").agg(F.max_by(F.struct(F.col("shard").alias("target"), "n"), F.struct("n", F.xxhash64("grp", "shard"))).alias("b"))
        # Members leave a shard that has no unlinked row only for one that holds as many of them.
        wish = held.join(best.select(F.col("grp").alias("g"), F.col("b.target").alias("target"), F.col("b.n").alias("most")), F.col("grp") == F.col("g"))
        wish = wish.filter((F.col("shard") != F.col("target")) & (is_open | (F.col("n") <= F.col("most")))).select("g", F.col("shard").alias("s"), "target")
        linked = state.filter("grp IS NOT NULL")
        asks = linked.join(wish, (linked.grp == wish.g) & (linked.shard == wish.s), "left").select("rid", "grp", "shard", "target")
        asks = store.table(asks, "asks")
        asked = {(r["shard"], r["target"]): r["n"] for r in asks.filter("target IS NOT NULL").groupBy("shard", "target").agg(F.count("*").alias("n")).collect()}
        admitted, plan = _admit(asked, spare, n_shards)
        if not admitted:
            store.drop(asks)
            break
        # Only rows that may move are ranked: those that ask, and unlinked rows of shards that give some away.
        gives = F.col("shard").isin([i for i, _, _ in plan]) if plan else F.lit(False)
        free = state.filter("grp IS NULL")
        may = asks.filter("target IS NOT NULL").withColumnRenamed("target", "to").unionByName(free.filter(gives).withColumn("to", F.lit(-1)))
        ranked = gapless(may, ["shard", "to"], "rid", n, "rank")
        # A row of the plan moves the ranks [lo, hi) of a (shard, to); there are at most n_shards**2 + 2 * n_shards of them.
        steps, at = [(i, j, 0, m, j) for (i, j), m in admitted.items()], {}
        for i, j, m in plan:
            a = at.get(i, 0)
            steps.append((i, -1, a, a + m, j))
            at[i] = a + m
        moves = rows.sparkSession.createDataFrame(steps, "ps int, pt int, lo long, hi long, dest int")
        on = (F.col("shard") == F.col("ps")) & (F.col("to") == F.col("pt")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
        moved = ranked.join(F.broadcast(moves), on, "left").select("rid", "grp", F.coalesce("dest", "shard").cast("int").alias("shard"))
        stay = asks.filter("target IS NULL").select("rid", "grp", "shard").unionByName(free.filter(~gives).select("rid", "grp", "shard"))
        new = store.table(moved.unionByName(stay), "shards")
        store.drop(state)
        store.drop(asks)
        state = new
    return settle(state, n), n


def shard(docs: DataFrame, doc_id: str = "doc_id", column: str = "text", n_shards: int = N_SHARDS, link: Column | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """One row for each input row: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    Law ``rows``: shard counts are at most one apart. ``link`` groups rows that
    should share a shard; equal texts by default (by SHA-256; a null text equals an empty
    one), and rows with a null link are unlinked. size: UTF-8 bytes of the text plus 8.
    Slots are gapless from 0 in each shard. Null ids and repeated rows are placed
    as any other; an empty table gives an empty result; other columns are ignored.
    """
    t = F.coalesce(F.col(column).cast("string"), F.lit(""))
    grp = F.unhex(F.sha2(t, 256)) if link is None else link
    rows = store.table(
        docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), grp.alias("grp")),
        "rows",
    )
    state, n = propagate(rows, n_shards, max_rounds)
    placed = gapless(state.select("rid", "shard"), ["shard"], "rid", n, "slot").withColumnRenamed("rid", "r")
    out = rows.join(placed, F.col("rid") == F.col("r"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
