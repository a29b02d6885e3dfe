"""Sharding by balanced label propagation.

Documents that are linked (here: by a common group, such as equal texts) should share a shard while all shards
have the same number of rows, give or take one. Rows start in shards by a hash. In each round every group without a place asks for the
shard where most of its members are, among the shards that have room for all of it; a shard's room is shared out by quotas for each size of group, and
members of the groups within a quota move there. A group that is refused asks for its next shard in the next round. Large groups come first, octave by octave
down to a 64th of a shard, then all smaller ones. Every round places a group at least, and rounds end when no group that is left fits any shard whole. Those groups, and
documents without links, then fill what is left. A group larger than a shard is cut into pieces of a shard each and a rest.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import drop, ranked, stored

SALTS = 32
#: Groups of up to a shard's rows by this are placed together, after the larger ones by octaves.
SMALL = 64


def _salted_votes(members: DataFrame, votes: DataFrame, keys: list[str]) -> DataFrame:
    """members joined with the one row of their group; a large group's members meet copies of that row in SALTS tasks. Never by a broadcast: Spark takes the
    copies for as large as one of them, and their number grows with the groups."""
    copies = votes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("_salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(copies.hint("merge"), [*keys, "_salt"]).drop("_salt")


def quotas(asked: list[tuple[int, int, int, int]], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """asked: goal, class, number of groups, size of the largest. How many groups of each goal and class may move there: the largest classes first, as many as
    fit whatever their sizes in the class."""
    out, left = {}, dict(room)
    for goal, kind, n, largest in sorted(asked, key=lambda a: (a[0], -a[1])):
        out[goal, kind] = min(n, left[goal] // largest)
        left[goal] -= out[goal, kind] * largest
    return out


def _bids(units: DataFrame, room: dict[int, int], turn: int) -> DataFrame:
    """units with the shard each asks for: of those with room for it the one with most of its members, a hash deciding between equal ones; null where none has."""
    shards = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(n).cast("long").alias("room")) for s, n in room.items()])
    fits = F.filter(shards, lambda s: s["room"] >= F.col("size"))
    score = lambda s: F.struct(F.coalesce(F.element_at("held", s["shard"]), F.lit(0)).alias("n"), F.xxhash64("group", "piece", s["shard"], F.lit(turn)).alias("tie"), s["shard"].alias("shard"))
    # Single sizes up to 64, then 64 classes an octave.
    kind = F.when(F.col("size") <= 64, F.col("size")).otherwise(F.floor(F.log2("size") * 64)).cast("int")
    return units.select("group", "piece", "size", "held", kind.alias("kind"), F.array_max(F.transform(fits, score))["shard"].alias("goal"))


def propagate(members: DataFrame, shards: int, room: dict[int, int]) -> DataFrame:
    """uid, group, piece, shard of the members (uid, group, piece) whose piece has found a shard; `room`: rows that each shard takes."""
    keys = ["group", "piece"]
    start = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")
    cells = members.groupBy(*keys, start.alias("shard")).agg(F.count("*").alias("n"))
    units = stored(cells.groupBy(*keys).agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("held")))
    room, most = dict(room), max(room.values())
    octave = F.least(F.floor(F.log2(F.lit(float(most)) / F.col("size"))), F.lit(int(math.log2(SMALL))))
    phases = [r["o"] for r in units.select(octave.alias("o")).distinct().orderBy("o").collect()]  # seven at most
    placed, turn = [], 0
    for phase in phases:
        waiting, temporary = units.filter(octave == phase), None
        while True:
            bids = stored(_bids(waiting, room, turn).filter("goal IS NOT NULL"))
            if temporary is not None:
                drop(temporary)
            turn += 1
            asked = [tuple(r) for r in bids.groupBy("goal", "kind").agg(F.count("*").alias("n"), F.max("size")).collect()]  # shards x classes
            if not asked:
                drop(bids)
                break
            given = [(goal, kind, n) for (goal, kind), n in quotas(asked, room).items() if n]
            quota = members.sparkSession.createDataFrame(given, "goal int, kind int, quota long")
            order = ranked(bids.join(F.broadcast(quota), ["goal", "kind"]), ["goal", "kind"], keys, "_rank", buckets=16)
            won = stored(order.filter(F.col("_rank") < F.col("quota")).select(*keys, "size", "goal"))
            placed.append(won)
            for r in won.groupBy("goal").agg(F.sum("size").alias("n")).collect():
                room[r["goal"]] -= r["n"]
            waiting, temporary = bids.join(won.select(*keys), keys, "left_anti").select(*keys, "size", "held"), bids
    if not placed:
        return members.select("uid", *keys, F.lit(0).alias("shard")).limit(0)
    goals = placed[0]
    for won in placed[1:]:
        goals = goals.unionAll(won)
    out = stored(_salted_votes(members, goals.select(*keys, F.col("goal").alias("shard")), keys).select("uid", *keys, "shard"))
    drop(units, *placed)
    return out


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes of the text, plus 8), text_crc32, law (`rows`: counts of shards at most one apart), shard,
    slot (gapless from 0 in each shard) and grown_shard (null under this law).

    Needs doc_id and text; further columns are left out. A null text has no bytes and is linked like an empty one. Equal texts
    are linked. Every row is placed, repeated ids too; empty tables give no rows. Of texts only length, checksum and digest are kept, however long they are."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("group"))
    rows = ranked(rows, [], ["doc_id", "group"], "uid")
    rows = stored(rows)
    n = rows.count()
    base, extra = divmod(n, shards)
    target = [base + (s < extra) for s in range(shards)]

    whole = max(base, 1)
    sizes = rows.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
    linked = _salted_votes(rows.select("uid", "group"), sizes, ["group"])
    # Pieces of groups that are larger than a shard, of which there are fewer than shards.
    large = ranked(linked.filter(F.col("n") > whole).select("uid", "group"), ["group"], ["uid"], "at")
    pieces = large.select("uid", "group", F.floor(F.col("at") / whole).cast("long").alias("piece"))
    members = stored(pieces.unionAll(linked.filter(F.col("n") <= whole).select("uid", "group", F.lit(0).cast("long").alias("piece"))))
    placed = ranked(propagate(members, shards, dict(enumerate(target))), ["shard"], ["group", "uid"], "slot")
    quota = F.element_at(F.create_map(*[F.lit(x) for s, t in enumerate(target) for x in (s, t)]), F.col("shard"))
    kept = stored(placed.filter(F.col("slot") < quota).select("uid", "shard", "slot"))
    load = {r["shard"]: r["count"] for r in kept.groupBy("shard").count().collect()}

    rest = ranked(rows.select("uid").join(kept.select("uid").hint("merge"), "uid", "left_anti"), [], ["uid"], "place")
    # Gaps of the shards, one after the other, are filled in the order of the rest's ranks.
    gaps, at = [], 0
    for s in range(shards):
        if gap := target[s] - load.get(s, 0):
            gaps.append((at, at + gap, s, load.get(s, 0)))
            at += gap
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for first, last, s, used in reversed(gaps):
        shard = F.when(F.col("place") < last, F.lit(s)).otherwise(shard)
        slot = F.when(F.col("place") < last, F.col("place") - first + used).otherwise(slot)
    filled = rest.select("uid", shard.alias("shard"), slot.alias("slot"))
    place = kept.unionByName(filled)
    return rows.join(place, "uid").select("doc_id", (F.col("bytes") + 8).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
