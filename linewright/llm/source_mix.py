"""Mixing sources to target weights with a Pfair schedule.

The documents of a source, in hash order, are cut into blocks, and each block
into two turns. Turns get release times and deadlines from the weight of their
source, and each slot goes to the released turn with the earliest deadline.

Slots are scheduled in cycles, so that a corpus of any size is spread over tasks.
First, turns get a cycle: of the ``r`` slots of a cycle a source with weight w
takes what brings it to ``floor(t * w)`` at the cycle's end t, and slots that
remain go to the earliest deadlines. Sums are carried on in whole numbers, so no
rounding repeats from cycle to cycle; a source is less than one turn off its weight
at the end of each cycle. Then each cycle is scheduled by itself: a source with q
turns there may place turn j no earlier than slot ``floor(j * r / q)`` and before
``ceil((j + 1) * r / q)``, which costs less than one turn more. So at any
moment each source, however small, is less than one block away from its weight.

The schedule ends when a source has no documents left for its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.llm.columns import unused
from linewright.operators.scans import running_position
from linewright.session import materialize, spread

#: Without given weights a source weighs its natural share, but at most this, unless there are too few sources.
MAX_SHARE = 0.25
#: Documents in a block, an even number.
BLOCK_ROWS = 16
#: Weights are whole numbers with about this sum.
UNITS = 10**12
#: The least number of slots in a cycle; long schedules have as many cycles as slots in each.
CYCLE_SLOTS = 64


def _given_weights(sources: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``(source, turns, lane, weight)`` for the named sources that have rows."""
    named = sorted((name, w) for name, w in weights.items() if w > 0)
    rows = F.array(*[F.struct(F.lit(name).alias("named"), F.lit(float(w)).alias("given"), F.lit(i).alias("lane")) for i, (name, w) in enumerate(named)])
    table = sources.sparkSession.range(1).select(F.inline(rows))
    lanes = sources.join(table, sources.source == table.named)
    share = F.col("given") / F.sum("given").over(Window.partitionBy())
    return lanes.select("source", "turns", "lane", F.greatest(F.lit(1), F.floor(share * UNITS)).cast("long").alias("weight"))


def _natural_weights(sources: DataFrame, max_share: float) -> DataFrame:
    """``(source, turns, lane, weight)``: natural shares under a ceiling.

    What sources at the ceiling give up goes to the others in proportion to their
    turns. With few sources the ceiling is an even share. Where none is at the
    ceiling the weights are exact, so all sources end together.
    """
    everything = Window.partitionBy()
    down = everything.orderBy(F.desc("turns"), F.asc_nulls_first("source"))
    ranked = sources.select(
        "source",
        "turns",
        F.row_number().over(down).alias("lane"),
        F.sum("turns").over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("rest"),
        F.greatest(F.lit(max_share), 1.0 / F.count("*").over(everything)).alias("cap"),
    )
    ranked = ranked.withColumn("capped", F.col("turns") / F.col("rest") * (1.0 - (F.col("lane") - 1) * F.col("cap")) > F.col("cap"))
    ranked = ranked.withColumn("free", 1.0 - F.sum(F.col("capped").cast("int")).over(everything) * F.col("cap"))
    ranked = ranked.withColumn("free_turns", F.sum(F.when(~F.col("capped"), F.col("turns"))).over(everything))
    ranked = ranked.withColumn("scale", F.greatest(F.lit(1), F.floor(F.col("free") * float(UNITS) / F.col("free_turns"))).cast("long"))
    at_ceiling = F.floor(F.col("cap") / F.col("free") * (F.col("scale") * F.col("free_turns"))).cast("long")
    weight = F.when(F.col("free_turns").isNull(), 1).when(F.col("capped"), at_ceiling).otherwise(F.col("turns") * F.col("scale"))
    return ranked.select("source", "turns", "lane", weight.cast("long").alias("weight"))


def _weighed(rows: DataFrame, weights: dict[str, float] | None, max_share: float, turn_rows: int) -> DataFrame:
    """``(source, turns, lane, weight)`` of the sources of ``rows``."""
    sources = rows.groupBy("source").agg(F.expr(f"(count(*) + {turn_rows - 1}) div {turn_rows}").alias("turns"))
    return materialize(_given_weights(sources, weights) if weights else _natural_weights(sources, max_share), "mix-weights")


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def cycle_table(lanes: DataFrame) -> DataFrame:
    """``(start, n, lanes)``, one row per cycle: its first slot, its number of slots, and ``(lane, quanta, first)`` of the lanes with turns in it.

    Earliest deadline first among turns, cycle by cycle, as a fold over cycles:
    ``lag`` is what a lane is behind its weight, in units of which ``d`` are a turn.
    One row holds all lanes and cycles, about the square root of the schedule.
    """
    row = lanes.agg(F.sort_array(F.collect_list(F.struct("lane", "weight", "turns"))).alias("lanes"), F.sum("weight").alias("d"))
    row = row.where(F.size("lanes") > 0)
    wide = "cast({} as decimal(19, 0))".format
    row = row.withColumn("e", F.expr(f"array_min(transform(lanes, x -> {wide('x.turns')} * {wide('d')} div {wide('x.weight')}))"))
    row = row.withColumn("r", F.greatest(F.lit(CYCLE_SLOTS), F.ceil(F.sqrt("e"))).cast("long")).withColumn("c", F.expr("(e + r - 1) div r"))
    grown = "transform(lanes, (x, i) -> named_struct('x', x, 'first', s.first[i], 'lag', s.lag[i] + x.weight * least(r, e - k * r)))"
    must = "greatest(0L, y.lag div d)"
    forced = f"transform(grown, y -> named_struct('x', y.x, 'first', y.first, 'must', {must}, 'left', y.lag - {must} * d))"
    due = "if(y.left > 0, named_struct('at', (d - y.left + y.x.weight - 1) div y.x.weight, 'lane', y.x.lane), null)"
    remain = "cast(least(r, e - k * r) - aggregate(forced, 0L, (n, y) -> n + y.must) as int)"
    last = f"get(array_sort(filter(transform(forced, y -> {due}), z -> z is not null)), {remain} - 1)"
    taken = f"transform(forced, y -> named_struct('x', y.x, 'first', y.first, 'left', y.left, 'must', y.must, 'more', if({due} <= last, 1L, 0L)))"
    state = """named_struct(
      'lag', transform(taken, y -> y.left - y.more * d),
      'first', transform(taken, y -> y.first + y.must + y.more),
      'cycles', array_append(s.cycles, transform(filter(taken, y -> y.must + y.more > 0),
        y -> named_struct('lane', y.x.lane, 'quanta', y.must + y.more, 'first', y.first))))"""
    fold = f"""
      aggregate(
        sequence(0L, c - 1),
        named_struct('lag', transform(lanes, x -> 0L), 'first', transform(lanes, x -> 0L),
          'cycles', cast(array() as array<array<struct<lane:int,quanta:bigint,first:bigint>>>)),
        (s, k) -> {_let("grown", grown, _let("forced", forced, _let("last", last, _let("taken", taken, state))))},
        s -> s.cycles)
    """
    cycles = row.select("r", "e", F.posexplode(F.expr(fold)).alias("k", "lanes"))
    return cycles.select(F.expr("k * r").alias("start"), F.expr("least(r, e - k * r)").alias("n"), "lanes")


def slot_table(cycles: DataFrame) -> DataFrame:
    """``(lane, turn, release, deadline, slot)`` of all turns of the schedule; each cycle is a fold over its slots."""
    best = """array_min(transform(lanes, (x, i) ->
      if(s.served[i] < x.quanta and s.served[i] * n div x.quanta <= slot,
        named_struct('deadline', ((s.served[i] + 1) * n + x.quanta - 1) div x.quanta, 'i', i), null)))"""
    state = """named_struct(
      'served', transform(s.served, (m, i) -> if(i = best.i, m + 1, m)),
      'places', array_append(s.places, named_struct('i', best.i, 'nth', s.served[best.i])))"""
    fold = f"""
      aggregate(
        sequence(0L, n - 1),
        named_struct('served', transform(lanes, x -> 0L), 'places', cast(array() as array<struct<i:int,nth:bigint>>)),
        (s, slot) -> {_let("best", best, state)},
        s -> s.places)
    """
    placed = spread(cycles, "start").select("start", "n", "lanes", F.posexplode(F.expr(fold)).alias("at", "turn"))
    placed = placed.select("start", "n", "at", F.col("turn.nth").alias("nth"), F.get("lanes", F.col("turn.i")).alias("x"))
    return placed.select(
        F.col("x.lane").alias("lane"),
        F.expr("x.first + nth").alias("turn"),
        F.expr("start + nth * n div x.quanta").alias("release"),
        F.expr("start + ((nth + 1) * n + x.quanta - 1) div x.quanta").alias("deadline"),
        F.expr("start + at").alias("slot"),
    )


def order_key(doc_id: Column) -> Column:
    """The order of documents within a source."""
    return F.struct(F.coalesce(F.md5(doc_id.cast("string")), F.lit("")).alias("digest"), doc_id.alias("doc_id"))


def _turn_rows(block_rows: int) -> int:
    if block_rows < 2 or block_rows % 2:
        raise ValueError("a block has an even number of documents")
    return block_rows // 2


def _ranked(rows: DataFrame, weighed: DataFrame) -> DataFrame:
    """``(doc_id, source, lane, digest, position)``: the documents of each lane in hash order, from one."""
    member = weighed.select(F.col("source").alias("named"), "lane")
    laned = rows.join(member, rows.source.eqNullSafe(member.named), "left").select("doc_id", "source", "lane")
    keyed = laned.withColumn("digest", order_key(F.col("doc_id"))["digest"])
    return running_position(keyed, ["lane"], "digest", "position", ties=["doc_id"])


def plan(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    max_share: float = MAX_SHARE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(doc_id, source, lane, block, turn, release, deadline, slot, place, in_mix)``, one row per document.

    ``slot`` is the turn's place in the mixture, ``place`` the document's in the
    turn; ``block`` and ``turn`` count from zero within the source, whose number
    is ``lane``. The mixture lasts until the source with the least documents for
    its weight has none left; what others hold beyond that has no slot, and
    ``in_mix`` false. With given weights, documents of sources without one have
    no lane either. A null source is a source of its own; repeated rows are
    documents of their own. Other columns are not looked at. An empty table
    gives no rows. The work per turn grows with the sources that a cycle serves,
    and the list of all sources is held in one row.
    """
    turn_rows = _turn_rows(block_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"))
    weighed = _weighed(rows, weights, max_share, turn_rows)
    slots = materialize(slot_table(materialize(cycle_table(weighed), "mix-cycles")), "mix-slots")
    slots = slots.withColumnsRenamed({"lane": "s_lane", "turn": "s_turn"})
    ranked = _ranked(rows, weighed).withColumn("turn", F.expr(f"(position - 1) div {turn_rows}"))
    return ranked.join(slots, (F.col("lane") == F.col("s_lane")) & (F.col("turn") == F.col("s_turn")), "left").select(
        "doc_id",
        "source",
        "lane",
        F.expr("if(lane is null, null, turn div 2)").alias("block"),
        F.expr("if(lane is null, null, turn)").alias("turn"),
        "release",
        "deadline",
        "slot",
        F.expr(f"(position - 1) % {turn_rows}").alias("place"),
        F.col("slot").isNotNull().alias("in_mix"),
    )


def mixed(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    max_share: float = MAX_SHARE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The rows of ``docs`` that are in the mix, all columns as they were.

    Within a source the mix holds the first documents in hash order, so one
    bound per source says which rows stay, and no text is moved. Sources that are
    in the mix as a whole are not even ranked.
    """
    turn_rows = _turn_rows(block_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"))
    weighed = _weighed(rows, weights, max_share, turn_rows)
    served = cycle_table(weighed).select(F.inline("lanes")).groupBy(F.col("lane").alias("s_lane")).agg(F.sum("quanta").alias("served"))
    served = materialize(weighed.join(served, weighed.lane == F.col("s_lane")).select("source", "turns", "lane", "served"), "mix-served")
    cut = served.where("served < turns")
    cut_rows = rows.join(cut.select(F.col("source").alias("named")), F.col("source").eqNullSafe(F.col("named")), "left_semi")
    ranked = _ranked(cut_rows, cut).join(cut.select(F.col("lane").alias("c_lane"), "served"), F.col("lane") == F.col("c_lane"))
    last = F.max(order_key(F.col("doc_id"))).alias("last")
    bounds = ranked.where(F.col("position") <= F.col("served") * turn_rows).groupBy(F.col("lane").alias("b_lane")).agg(last)
    bounds = served.join(bounds, F.col("lane") == F.col("b_lane"), "left").select("source", (F.col("served") >= F.col("turns")).alias("whole"), "last")
    bounds = materialize(bounds, "mix-bounds")
    named, whole, last_key = unused(docs, "named", "whole", "last")
    bounds = bounds.select(F.col("source").alias(named), F.col("whole").alias(whole), F.col("last").alias(last_key))
    kept = docs.join(bounds, docs[source].eqNullSafe(bounds[named]))
    return kept.where(F.col(whole) | (order_key(docs[doc_id]) <= F.col(last_key))).select(*docs.columns)


def places(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    max_share: float = MAX_SHARE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(doc_id, source, at)``: where the documents of the mix stand in it, counted over whole turns from zero.

    Rows that share id and source are one row here, at the place of the first of them.
    """
    mix = plan(docs, weights, doc_id, source, max_share, block_rows).where("in_mix")
    at = F.min(F.col("slot") * _turn_rows(block_rows) + F.col("place")).alias("at")
    return mix.groupBy("doc_id", "source").agg(at)


def in_order(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    max_share: float = MAX_SHARE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The rows of ``mixed`` in the order of the schedule, slot by slot, all columns as they were.

    Partitions, and so the files they are written to, follow each other in the
    mixture. Rows that share id and source stand together. The schedule is made
    of ids and sources alone; texts move twice, to meet their place and to go
    there.
    """
    placed = materialize(places(docs, weights, doc_id, source, max_share, block_rows), "mix-places")
    end = (placed.agg(F.max("at")).first()[0] or 0) + 1
    named, origin, place = unused(docs, "named", "origin", "at")
    placed = placed.select(F.col("doc_id").alias(named), F.col("source").alias(origin), F.col("at").alias(place))
    same = docs[doc_id].eqNullSafe(placed[named]) & docs[source].eqNullSafe(placed[origin])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col(place) * parts / end).cast("int")  # places are dense, so parts are even
    return docs.join(placed, same).repartitionById(parts, part).sortWithinPartitions(place, named).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


TURN_ROWS = BLOCK_ROWS // 2
SQL = f"""
WITH RECURSIVE sources AS (
  SELECT source, (count(*) + {TURN_ROWS - 1}) // {TURN_ROWS} AS turns FROM documents GROUP BY source
), ranked AS (
  SELECT source, turns, row_number() OVER (ORDER BY turns DESC, source NULLS FIRST) AS lane,
    sum(turns) OVER (ORDER BY turns DESC, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    greatest({MAX_SHARE}::DOUBLE, 1.0::DOUBLE / count(*) OVER ()) AS cap
  FROM sources
), capped AS (
  SELECT *, turns::DOUBLE / rest * (1.0::DOUBLE - (lane - 1) * cap) > cap AS capped FROM ranked
), freed AS (
  SELECT *, 1.0::DOUBLE - count(*) FILTER (capped) OVER () * cap AS free,
    (sum(turns) FILTER (NOT capped) OVER ())::BIGINT AS free_turns
  FROM capped
), scaled AS (
  SELECT *, greatest(1, floor(free * {float(UNITS):.1f}::DOUBLE / free_turns)::BIGINT) AS scale FROM freed
), weighed AS (
  SELECT source, turns, lane::INTEGER AS lane, CASE WHEN free_turns IS NULL THEN 1
    WHEN capped THEN floor(cap / free * (scale * free_turns))::BIGINT ELSE turns * scale END AS weight
  FROM scaled
), totals AS (
  SELECT list({{'lane': lane, 'weight': weight}} ORDER BY lane) AS lanes, sum(weight)::BIGINT AS d FROM weighed
), ended AS (
  SELECT lanes, d, (SELECT min(turns::HUGEINT * d // weight) FROM weighed)::BIGINT AS e FROM totals
), config AS (
  SELECT *, greatest({CYCLE_SLOTS}, ceil(sqrt(e::DOUBLE))::BIGINT) AS r FROM ended
), cycles AS (
  SELECT -1::BIGINT AS k, list_transform(lanes, lambda x: 0::BIGINT) AS lag,
    list_transform(lanes, lambda x: 0::BIGINT) AS q, list_transform(lanes, lambda x: 0::BIGINT) AS first, lanes, d, e, r FROM config
  UNION ALL
  SELECT k, list_transform(y, lambda v: v.lag - (v.must + CASE WHEN v.due <= last THEN 1 ELSE 0 END) * d),
    list_transform(y, lambda v: v.must + CASE WHEN v.due <= last THEN 1 ELSE 0 END), first, lanes, d, e, r
  FROM (
    SELECT *, CASE WHEN remain > 0 THEN list_sort(list_filter(list_transform(y, lambda v: v.due), lambda z: z IS NOT NULL))[remain] END AS last
    FROM (
      SELECT *, least(r, e - k * r) - list_sum(list_transform(y, lambda v: v.must))::BIGINT AS remain
      FROM (
        SELECT k, first, lanes, d, e, r, list_transform(grown, lambda g, j: {{'lag': g, 'must': greatest(0, g // d),
          'due': CASE WHEN g - greatest(0, g // d) * d > 0
            THEN {{'at': (d - (g - greatest(0, g // d) * d) + lanes[j].weight - 1) // lanes[j].weight, 'lane': lanes[j].lane}} END}}) AS y
        FROM (
          SELECT k + 1 AS k, lanes, d, e, r, list_transform(first, lambda f, j: f + q[j]) AS first,
            list_transform(lag, lambda l, j: l + lanes[j].weight * least(r, e - (k + 1) * r)) AS grown
          FROM cycles WHERE (k + 1) * r < e
        )
      )
    )
  )
), steps AS (
  SELECT k, least(r, e - k * r) AS n, k * r AS start, -1::BIGINT AS place, list_transform(q, lambda x: 0::BIGINT) AS served,
    0::BIGINT AS best, 0::BIGINT AS nth, q, first, lanes
  FROM cycles WHERE k >= 0
  UNION ALL
  SELECT k, n, start, place, list_transform(served, lambda s, j: CASE WHEN j = best THEN s + 1 ELSE s END), best, served[best], q, first, lanes
  FROM (
    SELECT k, n, start, place + 1 AS place, served, q, first, lanes, list_min(list_transform(q, lambda a, j:
      CASE WHEN served[j] < a THEN CASE WHEN served[j] * n // a <= place + 1
        THEN {{'deadline': ((served[j] + 1) * n + a - 1) // a, 'j': j}} END END)).j AS best
    FROM steps WHERE place + 1 < n
  )
), slots AS (
  SELECT lanes[best].lane AS lane, first[best] + nth AS turn, start + nth * n // q[best] AS release,
    start + ((nth + 1) * n + q[best] - 1) // q[best] AS deadline, start + place AS slot
  FROM steps WHERE place >= 0
), docs AS (
  SELECT d.doc_id, d.source, w.lane, row_number() OVER (PARTITION BY w.lane ORDER BY md5(d.doc_id::VARCHAR), d.doc_id) - 1 AS position
  FROM documents d JOIN weighed w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT d.doc_id, d.source, d.lane, position // {BLOCK_ROWS} AS block, position // {TURN_ROWS} AS turn, s.release, s.deadline, s.slot,
  position % {TURN_ROWS} AS place, s.slot IS NOT NULL AS in_mix
FROM docs d LEFT JOIN slots s ON s.lane = d.lane AND s.turn = position // {TURN_ROWS}
"""
