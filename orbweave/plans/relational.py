"""Registered queries that have equivalent SQL. Each is a function of (spark, sf_dir), with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import numeric, text
from ..operators import blocks, cost, deltas, frames, mapping, runs, topology
from ..sources import adapters

PRECISION = 0.01


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str


QUERIES: dict[str, Query] = {}


def query(sql: str):
    def put(run):
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return put


GRID = """
g as (select vec_id as frame, cast((i - 1) // 3 as bigint) as particle, cast((i - 1) % 3 as bigint) as dim, cast(embedding[i] as double) as value
      from embeddings, (select unnest(range(1, 64)) as i))"""
QUANTISED = GRID + f""",
q as (select frame, frame // 100 as frame_set, particle, dim, cast(floor(value / {PRECISION} + 0.5) as bigint) as q from g)"""
DELTA_INTER = QUANTISED + """,
d as (select *, q - coalesce(lag(q) over (partition by frame_set, particle, dim order by frame), 0) as delta from q)"""
DELTA_INTRA = QUANTISED + """,
d as (select *, q - coalesce(lag(q) over (partition by frame, dim order by particle), 0) as delta from q)"""


@query(f"with {GRID} select frame, particle, dim, value from g")
def grid_scan(spark, d):
    return adapters.grid(spark, d)


@query(f"with {GRID} select frame, particle, dim, value from g where frame between 50 and 149")
def frame_range_dense(spark, d):
    return adapters.long_form(frames.in_range(adapters.frames(spark, d).select("frame", "values"), 50, 149))


@query("select event_id as frame, value from events where event_id between 777 and 1888 and event_id % 5 = 0")
def frame_range_strided(spark, d):
    return frames.in_range_strided(adapters.series(spark, d), 777, 1888, 5)


@query("select event_id as frame, event_id // 100 as frame_set, s.first_frame from events join (select event_id // 100 as fs, min(event_id) as first_frame from events group by 1) s on event_id // 100 = s.fs")
def frame_set_of_frame(spark, d):
    rows = adapters.series(spark, d)
    sets = frames.frame_sets(rows)
    return rows.select("frame", adapters.frame_set_of().alias("frame_set")).join(sets.select("frame_set", "first_frame"), "frame_set").select("frame", "frame_set", "first_frame")


SETS = "s as (select event_id // 100 as frame_set, min(event_id) as first_frame, count(*) as n_frames from events group by 1)"


@query(f"""with {SETS} select *, lag(frame_set, 1) over w as prev, lead(frame_set, 1) over w as next, lag(frame_set, 5) over w as medium_prev, lead(frame_set, 5) over w as medium_next,
lag(frame_set, 25) over w as long_prev, lead(frame_set, 25) over w as long_next from s window w as (order by frame_set)""")
def frame_set_directory(spark, d):
    return frames.directory(frames.frame_sets(adapters.series(spark, d)))


@query(f"with {SETS} select * from s where frame_set = 7")
def frame_set_nth(spark, d):
    return frames.nth_set(frames.frame_sets(adapters.series(spark, d)), 7)


@query(f"with {SETS} select cast(max_by(first_frame + n_frames, first_frame) as bigint) as num_frames from s")
def num_frames(spark, d):
    return frames.num_frames(frames.frame_sets(adapters.series(spark, d)))


@query(f"with {SETS} select count(*) as num_sets from s")
def num_sets(spark, d):
    return frames.num_sets(frames.frame_sets(adapters.series(spark, d)))


def _sparse_blocks(spark, d):
    """Three blocks with data at strides 1, 5 and 20."""
    sets = frames.frame_sets(adapters.series(spark, d))
    return sets.withColumn("b", F.explode(F.array(*(F.struct(F.lit(i).alias("block_id"), F.lit(s).alias("stride")) for i, s in ((0, 1), (1, 5), (2, 20)))))).select("b.block_id", "b.stride", "first_frame", "n_frames", F.col("first_frame").alias("first_with_data"))


@query(f"with {SETS} select block_id, cast(sum((n_frames - (first_frame - first_frame)) // stride) as bigint) as n_with_data from s, (values (0, 1), (1, 5), (2, 20)) b(block_id, stride) group by block_id")
def frames_with_block(spark, d):
    return frames.frames_with_block(_sparse_blocks(spark, d))


@query("select event_id as frame, 2e-15 * (event_id // 100 * 100) + 1e-15 * (event_id - event_id // 100 * 100) as seconds from events")
def time_of_frame(spark, d):
    rows = adapters.series(spark, d).select("frame", (adapters.frame_set_of() * 100).alias("first"))
    return rows.select("frame", frames.time_of_frame(F.col("frame"), F.col("first"), F.lit(2e-15) * F.col("first"), F.lit(1e-15)).alias("seconds"))


@query("select event_id as frame, lead(event_id) over (order by event_id) as next_frame from events where event_id % 7 = 0")
def next_frame_with_data(spark, d):
    return frames.next_with_data(adapters.series(spark, d).where("frame % 7 = 0").select("frame"))


@query("select r as frame, coalesce(value, 0.0) as value from range(1000, 1200) t(r) left join (select * from events where event_id % 3 = 0) e on e.event_id = r")
def dense_allocation(spark, d):
    return frames.dense(adapters.series(spark, d).where("frame % 3 = 0"), 1000, 1199)


TOPOLOGY = """
m as (
  select cast(n_nationkey as bigint) as mol_idx, n_nationkey + 1 as mol_id, n_name as name, coalesce(a.n, 0) as n_atoms, (coalesce(a.n, 0) + 2) // 3 as n_residues, coalesce(c.n, 0) as cnt
  from nation left join (select s_nationkey, count(*) as n from supplier group by 1) a on s_nationkey = n_nationkey
  left join (select c_nationkey, count(*) as n from customer group by 1) c on c_nationkey = n_nationkey),
t as (
  select *, cast(coalesce(sum(n_atoms * cnt) over w, 0) as bigint) as first_particle, cast(coalesce(sum(n_residues * cnt) over w, 0) as bigint) as first_residue
  from m window w as (order by mol_idx rows between unbounded preceding and 1 preceding)),
a as (
  select cast(s_nationkey as bigint) as mol_idx, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as atom_idx, s_name as atom, case when s_acctbal < 0 then 'N' else 'P' end as atom_type from supplier),
p as (select event_id as particle, t.* from events left join t on event_id >= first_particle and event_id < first_particle + n_atoms * cnt)"""


def _particles(spark, d):
    return adapters.table(spark, d, "events").select(F.col("event_id").alias("particle"))


@query(f"with {TOPOLOGY} select particle, mol_idx, cast(mol_id as bigint) as mol_id, name as molecule from p")
def particle_to_molecule(spark, d):
    return topology.particle_to_molecule(_particles(spark, d), adapters.molecules(spark, d)).select("particle", "mol_idx", "mol_id", "molecule")


ATOM_SQL = """select particle, name as molecule, 'C' || cast(p.atom_idx // 3 // 2 as varchar) as chain, 'R' || cast(p.atom_idx // 3 as varchar) as residue, a.atom, coalesce(a.atom_type, '') as atom_type,
(p.atom_idx // 3) % 2 + first_residue + n_residues * ((particle - first_particle) // n_atoms) as global_residue
from (select *, {} % case when n_atoms > 0 then n_atoms end as atom_idx from p) p left join a on a.mol_idx = p.mol_idx and a.atom_idx = p.atom_idx"""


def _particle_names(spark, d, corrected):
    parts = (f(spark, d) for f in (adapters.molecules, adapters.atoms, adapters.residues, adapters.chains))
    return topology.particle_to_atom(_particles(spark, d), *parts, corrected=corrected).select("particle", "molecule", "chain", "residue", "atom", "atom_type", "global_residue")


@query(f"with {TOPOLOGY} {ATOM_SQL.format('particle')}")
def particle_names(spark, d):
    return _particle_names(spark, d, False)


@query(f"with {TOPOLOGY} {ATOM_SQL.format('(particle - first_particle)')}")
def particle_names_corrected(spark, d):
    return _particle_names(spark, d, True)


@query(f"""with {TOPOLOGY} select t.mol_idx, i as instance, first_particle + i * n_atoms + atom_idx - 1 as src, first_particle + i * n_atoms + atom_idx as dst
from a join t on a.mol_idx = t.mol_idx, unnest(range(cnt)) as r(i) where atom_idx % 3 > 0""")
def bonds_expanded(spark, d):
    return topology.bonds_expanded(adapters.molecules(spark, d), adapters.bonds(spark, d))


@query(f"with {TOPOLOGY} select cast(sum(cnt) as bigint) as n_molecules, cast(sum(n_atoms * cnt) as bigint) as n_particles from m")
def topology_totals(spark, d):
    return topology.totals(adapters.molecules(spark, d))


@query(f"with {TOPOLOGY} select fs as frame_set, cast(sum(cnt + fs) as bigint) as n_molecules, cast(sum(n_atoms * (cnt + fs)) as bigint) as n_particles from m, unnest(range(5)) r(fs) group by fs")
def totals_by_frame_set(spark, d):
    m = adapters.molecules(spark, d)
    counts = m.select("mol_idx", "cnt", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fs")).select(F.col("fs").cast("long").alias("frame_set"), "mol_idx", (F.col("cnt") + F.col("fs")).alias("cnt"))
    return topology.totals_by_set(counts, m)


@query(f"with {TOPOLOGY} select mol_idx, cast(mol_id as bigint) as mol_id, name from m where name like '%' and mol_id <> 7 order by mol_idx desc limit 1")
def find_last_molecule(spark, d):
    return topology.find(adapters.molecules(spark, d).where("mol_id <> 7"), "mol_idx").select("mol_idx", "mol_id", "name")


@query(f"with {TOPOLOGY} select mol_idx, max(atom_idx // 3) as res_idx from a where (atom_idx // 3) % 2 = 0 group by mol_idx")
def find_last_residue(spark, d):
    return topology.find(adapters.residues(spark, d), "res_idx", wanted_id=0, id_col="res_id", within=("mol_idx",)).select("mol_idx", "res_idx")


@query(f"with {TOPOLOGY} select mol_idx, max(atom_idx // 6) as chain_idx from a group by mol_idx")
def find_last_chain(spark, d):
    return topology.find(adapters.chains(spark, d), "chain_idx", within=("mol_idx",)).select("mol_idx", "chain_idx")


@query(f"with {TOPOLOGY} select mol_idx, atom_type, max(atom_idx) as atom_idx from a group by mol_idx, atom_type")
def find_last_atom(spark, d):
    return topology.find(adapters.atoms(spark, d), "atom_idx", within=("mol_idx", "atom_type")).select("mol_idx", "atom_type", "atom_idx")


@query(f"with {TOPOLOGY} select m.mol_idx, coalesce(max(atom_idx) // 6 + 1, 0) as n_chains, coalesce(max(atom_idx) // 3 + 1, 0) as n_residues, count(atom_idx) as n_atoms from m left join a on a.mol_idx = m.mol_idx group by m.mol_idx")
def child_counts(spark, d):
    return topology.child_counts(*(f(spark, d) for f in (adapters.molecules, adapters.chains, adapters.residues, adapters.atoms)))


@query(f"with {TOPOLOGY} select mol_idx, atom_idx, atom as name from a where atom_idx % 3 = 1")
def atom_of_residue(spark, d):
    return topology.atom_of_residue(adapters.atoms(spark, d), 1).select("mol_idx", "atom_idx", "name")


@query("""select r.r_name as molecule, n.n_name as chain, c.c_name as residue, o.o_orderkey as atom from orders o join customer c on o_custkey = c_custkey
join nation n on c_nationkey = n_nationkey join region r on n_regionkey = r_regionkey""")
def hierarchy_names(spark, d):
    t = lambda n: adapters.table(spark, d, n)
    rows = t("orders").select("o_orderkey", "o_custkey").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("r_name").alias("molecule"), F.col("n_name").alias("chain"), F.col("c_name").alias("residue"), F.col("o_orderkey").alias("atom"))


def _mappings(spark, sets):
    """Even sets number their particles from behind, odd ones have no mapping; the last particle of every fourth set is uncovered."""
    even = sets.where("frame_set % 2 = 0")
    numbers = F.sequence(F.lit(20).cast("long"), F.when(F.col("frame_set") % 4 == 0, 1).otherwise(0).cast("long"))
    return mapping.exploded(even.select("frame_set", F.lit(0).cast("long").alias("first"), numbers.alias("numbers")))


@query(f"""with {GRID} select frame, particle, dim, case when frame // 100 % 2 = 1 then particle when frame // 100 % 4 = 0 and particle = 20 then null else 20 - particle end as real_particle from g""")
def mapping_apply(spark, d):
    rows = adapters.grid(spark, d).withColumn("frame_set", adapters.frame_set_of())
    sets = rows.select("frame_set").distinct()
    return mapping.applied(rows, _mappings(spark, sets)).select("frame", "particle", "dim", "real_particle")


@query("""with b as (select n_regionkey as frame_set, n_nationkey as block, n_nationkey as first, 2 + n_nationkey % 5 * 3 as n from nation)
select a.frame_set, a.block as a, b.block as b from b as a join b on a.frame_set = b.frame_set and a.block < b.block
where (b.first >= a.first and b.first < a.first + a.n) or (b.first + b.n >= a.first and b.first + b.n < a.first + a.n) or (a.first >= b.first and a.first < b.first + b.n) or (a.first + a.n > b.first and a.first + a.n < b.first + b.n)""")
def mapping_overlap(spark, d):
    rows = adapters.table(spark, d, "nation").select(F.col("n_regionkey").alias("frame_set"), F.col("n_nationkey").alias("block"), F.col("n_nationkey").alias("first"), (2 + F.col("n_nationkey") % 5 * 3).alias("n"))
    return mapping.overlaps(rows)


@query(f"with {QUANTISED} select frame, particle, dim, q from q")
def quantise(spark, d):
    return adapters.long_form(deltas.quantised(adapters.frames(spark, d), PRECISION), "q", "q").drop("frame_set")


@query(f"with {QUANTISED} select frame, particle, dim, cast(q as double) * {PRECISION} as value from q")
def dequantise(spark, d):
    return adapters.long_form(deltas.dequantised(deltas.quantised(adapters.frames(spark, d), PRECISION), PRECISION)).drop("frame_set")


@query(f"with {GRID} select frame, particle, dim, cast(floor(value * {1.0 / PRECISION!r} + 0.5) as bigint) as q from g")
def quantise_reciprocal(spark, d):
    g = adapters.grid(spark, d)
    return g.select("frame", "particle", "dim", numeric.quantise_reciprocal(F.col("value"), PRECISION).alias("q"))


@query(f"with {QUANTISED} select frame, particle, dim, case when q > 0 then 2 * q - 1 else -2 * q end as z from q")
def zigzag(spark, d):
    rows = adapters.long_form(deltas.quantised(adapters.frames(spark, d), PRECISION), "q", "q")
    return rows.select("frame", "particle", "dim", numeric.zigzag(F.col("q")).alias("z"))


@query("select event_id, case when event_id % 2 = 0 then -(event_id // 2) else (event_id + 1) // 2 end as q from events")
def unzigzag(spark, d):
    return adapters.table(spark, d, "events").select("event_id", numeric.unzigzag(F.col("event_id")).alias("q"))


@query(f"with {DELTA_INTER} select frame, particle, dim, delta from d")
def delta_inter(spark, d):
    return adapters.long_form(deltas.inter(deltas.quantised(adapters.frames(spark, d), PRECISION)).drop("q"), "delta", "delta").drop("frame_set")


@query(f"with {DELTA_INTRA} select frame, particle, dim, delta from d")
def delta_intra(spark, d):
    return adapters.long_form(deltas.intra(deltas.quantised(adapters.frames(spark, d), PRECISION)).drop("q", "frame_set"), "delta", "delta")


@query(f"with {QUANTISED} select frame, particle, dim, q from q")
def undo_inter(spark, d):
    rows = adapters.long_form(deltas.inter(deltas.quantised(adapters.frames(spark, d), PRECISION)).drop("q"), "delta", "delta")
    return deltas.undo_inter(rows).select("frame", "particle", "dim", "q")


@query(f"with {QUANTISED} select frame, particle, dim, q from q")
def undo_intra(spark, d):
    rows = deltas.intra(deltas.quantised(adapters.frames(spark, d), PRECISION)).drop("q", "frame_set")
    return adapters.long_form(deltas.undo_intra(rows).drop("delta"), "q", "q")


@query(f"with {QUANTISED} select dim, min(q) as low, max(q) as high from q group by dim")
def bounding_box(spark, d):
    return deltas.bounding_box(deltas.quantised(adapters.frames(spark, d), PRECISION))


@query("""select event_id, cast(floor(abs(value)) as bigint) + case when value < 0 then 2147483648 else 0 end as high, cast(floor((abs(value) - floor(abs(value))) / 1.0 * 4294967295.0) as bigint) as low from events""")
def fixpoint_pair(spark, d):
    high, low = numeric.fixed_pair(F.col("value"))
    return adapters.table(spark, d, "events").select("event_id", high.alias("high"), low.alias("low"))


@query("select event_id, round(value, 6) as value from events")
def fixpoint_roundtrip(spark, d):
    high, low = numeric.fixed_pair(F.col("value"))
    return adapters.table(spark, d, "events").select("event_id", F.round(numeric.unfixed_pair(high, low), 6).alias("value"))


@query("select l_orderkey, l_linenumber, l_quantity + l_tax as a, -l_tax as b, l_tax + l_discount as c from lineitem")
def pair_swap(spark, d):
    a, b, c = numeric.pair_swap(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"))
    return adapters.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"), c.alias("c"))


@query("select event_id, (event_id * 7 - 5000 - (-100)) - floor((event_id * 7 - 5000 - (-100)) / 300.0) * 300 + (-100) as v from events")
def keep_in_box(spark, d):
    return adapters.table(spark, d, "events").select("event_id", numeric.keep_in_box((F.col("event_id") * 7 - 5000).cast("double"), -100.0, 200.0).alias("v"))


RUNS = """
s as (select event_id as frame, event_id // 100 as frame_set, event_type as sym from events),
i as (select *, row_number() over (partition by frame_set order by frame) - row_number() over (partition by frame_set, sym order by frame) as g from s),
r as (select frame_set, min(frame) as start, sym, count(*) as n from i group by frame_set, sym, g)"""


@query(f"with {RUNS} select * from r")
def rle_runs(spark, d):
    return runs.runs(adapters.symbols(spark, d))


@query("""with s as (select event_id as frame, event_type as sym, row_number() over (order by event_id) - row_number() over (partition by event_type order by event_id) as g from events)
select min(frame) as start, sym, count(*) as n from s group by sym, g""")
def rle_runs_joined(spark, d):
    return runs.joined_runs(runs.runs(adapters.symbols(spark, d))).select("start", "sym", "n")


@query("select event_id as frame, event_type as sym from events")
def unrle(spark, d):
    return runs.unrolled(runs.runs(adapters.symbols(spark, d)))


_BITS = "list_transform(string_split(reverse(substr(bin(n), 2)), ''), lambda b: cast(b as bigint))"


@query(f"with {RUNS} select start, [7] as digits from r where n = 1 union all select start, list_append({_BITS}, 7) from r where n > 1")
def run_digits(spark, d):
    return runs.runs(adapters.symbols(spark, d)).select("start", runs.run_digits(F.lit(5).cast("long"), F.col("n")).alias("digits"))


@query("select event_type as sym, count(*) as count, row_number() over (order by event_type) - 1 as code from events group by 1")
def histogram_dict(spark, d):
    return runs.histogram(adapters.symbols(spark, d))


@query("""with s as (select event_id as frame, event_id // 100 as frame_set, event_type as sym, lag(event_id) over (partition by event_id // 100, event_type order by event_id) as last from events)
select a.frame_set, a.frame, a.sym, case when max(a.last) is not null then count(distinct b.sym) end as mtf from s a left join s b on b.frame_set = a.frame_set and b.frame > a.last and b.frame < a.frame group by all""")
def mtf_ranks(spark, d):
    return runs.move_to_front(adapters.symbols(spark, d), "frame_set")


@query(f"with {DELTA_INTER} select count(*) filter (case when delta > 0 then 2 * delta - 1 else -2 * delta end >= 30) <= count(*) // 10 as few from d")
def few_large(spark, d):
    rows = adapters.long_form(deltas.inter(deltas.quantised(adapters.frames(spark, d), PRECISION)).drop("q"), "delta", "delta")
    return runs.few_large(rows.select(numeric.zigzag(F.col("delta")).alias("z")), "z", 30)


@query("""select event_id, case when v <= 32767 then [v] when v >> 15 <= 32767 then [(v & 32767) | 32768, v >> 15] else [(v & 32767) | 32768, ((v >> 15) & 32767) | 32768, v >> 30] end as digits
from (select event_id, (event_id * event_id * 977) % 4294967296 as v from events)""")
def vals16(spark, d):
    v = (F.col("event_id") * F.col("event_id") * 977) % 4294967296
    return adapters.table(spark, d, "events").select("event_id", text.vals16(v).alias("digits"))


@query("select event_id, (event_id * event_id * 977) % 4294967296 as v from events")
def vals16_roundtrip(spark, d):
    v = (F.col("event_id") * F.col("event_id") * 977) % 4294967296
    return adapters.table(spark, d, "events").select("event_id", text.from_vals16(text.vals16(v)).alias("v"))


def _values(rows):
    return ", ".join(f"({', '.join(map(str, r))})" for r in rows)


_WIDTH = "case when z > 0 then length(bin(z)) else 0 end"
STOP_BIT = DELTA_INTER + f""",
z as (select case when delta > 0 then 2 * delta - 1 else -2 * delta end as z from d),
w as (select {_WIDTH} as w, count(*) as n from z group by 1),
c(w, parameter, bits) as (values {_values((w, p, cost.stop_bit_bits(w, p)) for w in range(20) for p in cost.PARAMETERS)}),
stop_costs as (select parameter, cast(ceil(sum(n * bits) / 8.0) as bigint) as bytes from w join c using (w) group by parameter)"""
TRIPLET = DELTA_INTRA + f""",
z as (select frame, particle, max(case when delta > 0 then 2 * delta - 1 else -2 * delta end) as z from d group by all),
w as (select {_WIDTH} as w, count(*) as n from z group by 1),
c(w, m, parameter, bits) as (values {_values((w, m, p, cost.triplet_bits(w, p, m)) for m in range(16) for w in range(m + 1) for p in cost.PARAMETERS)}),
triplet_costs as (select parameter, cast(ceil((32 + sum(n * bits)) / 8.0) as bigint) as bytes from w join c using (w) where m = (select max(w) from w) group by parameter)"""


def _stop(spark, d):
    rows = adapters.long_form(deltas.inter(deltas.quantised(adapters.frames(spark, d), PRECISION)).drop("q"), "delta", "delta")
    return cost.stop_bit_costs(rows)


def _triplet(spark, d):
    return cost.triplet_costs(deltas.intra(deltas.quantised(adapters.frames(spark, d), PRECISION)))


@query(f"with {STOP_BIT} select * from stop_costs")
def stopbit_cost(spark, d):
    return _stop(spark, d)


@query(f"with {TRIPLET} select * from triplet_costs")
def triplet_cost(spark, d):
    return _triplet(spark, d)


@query(f"with {STOP_BIT}, x as ({'with ' + TRIPLET + ' select * from triplet_costs'}), both_ as (select 1 as priority, 'stop-bit inter' as codec, parameter, bytes from stop_costs union all select 0, 'triplet intra', parameter, bytes from x) select codec, parameter, bytes from both_ order by bytes, priority, parameter limit 1")
def codec_choice(spark, d):
    named = lambda rows, p, n: rows.select(F.lit(p).alias("priority"), F.lit(n).alias("codec"), "parameter", "bytes")
    return cost.cheapest(named(_stop(spark, d), 1, "stop-bit inter").unionByName(named(_triplet(spark, d), 0, "triplet intra")))


@query("select doc_id, md5(coalesce(text, '')) as md5, octet_length(encode(coalesce(text, ''))) as length from documents")
def block_md5(spark, d):
    rows = adapters.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    return blocks.digests(rows).select("doc_id", "md5", "length")


@query("select doc_id, case when text is not null then least(octet_length(encode(text)) + 1, 1024) end as length from documents")
def bounded_length(spark, d):
    return adapters.table(spark, d, "documents").select("doc_id", text.bounded_length(F.col("text")).alias("length"))


@query("select p_partkey, p_name, p_brand from part where p_name = (select p_name from part order by p_partkey limit 1) or p_partkey = 7")
def wildcard_match(spark, d):
    part = adapters.table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    first = part.orderBy("p_partkey").limit(1).select(F.col("p_name").alias("_n"))
    return part.join(F.broadcast(first), text.matches(F.col("p_name"), F.col("p_partkey")) & (F.col("p_name") == F.col("_n")) | text.matches(F.lit(""), F.col("p_partkey"), wanted_id=7)).drop("_n")


@query("""with s as (select distinct event_type as s from events), r as (select s, i, substr(s, i) || substr(s, 1, i - 1) as rot from s, unnest(range(1, length(s) + 1)) t(i))
select s, string_agg(right(rot, 1), '' order by rot) as bwt from r group by s""")
def bwt_small(spark, d):
    return adapters.symbols(spark, d).select(F.col("sym").alias("s")).distinct().select("s", text.block_sorted(F.col("s")).alias("bwt"))


ALPHABET = "abcdefghijklmnopqrstuvwxyz_-"


@query(f"""with c as (select distinct event_type as s, i, substr(event_type, i, 1) as ch from events, unnest(range(1, length(event_type) + 1)) t(i)),
p as (select *, strpos('{ALPHABET}', ch) - 1 as pos, lag(i) over (partition by s, ch order by i) as last from c),
r as (select a.s, a.i, case when any_value(a.last) is not null then count(distinct b.ch) filter (b.i > a.last) else any_value(a.pos) + count(distinct b.ch) filter (b.pos > a.pos) end as rank
      from p a left join p b on a.s = b.s and b.i < a.i group by a.s, a.i)
select s, list(cast(rank as integer) order by i) as ranks from r group by s""")
def mtf_small(spark, d):
    rows = adapters.symbols(spark, d).select(F.col("sym").alias("s")).distinct()
    return rows.select("s", text.move_to_front(F.col("s"), ALPHABET).alias("ranks"))


@query("select event_type as scope, frame_set, coalesce(own, fallback) as value from (select event_type, event_id // 100 as frame_set, max(value) filter (event_id % 3 = 0) as own from events group by all) join (select event_type as t, max(value) as fallback from events group by 1) on t = event_type")
def scope_fallback(spark, d):
    rows = adapters.symbols(spark, d).join(adapters.series(spark, d), "frame")
    of_set = rows.groupBy(F.col("sym").alias("scope"), "frame_set").agg(F.max(F.when(F.col("frame") % 3 == 0, F.col("value"))).alias("value"))
    return frames.scoped(of_set, rows.groupBy(F.col("sym").alias("scope")).agg(F.max("value").alias("value")), "scope", "value").select("scope", "frame_set", "value")


@query(f"select count(*) as n_ids, count(*) filter (block_id >= {schema.BOX_SHAPE}) as n_data from (values {', '.join(f'({k})' for k in schema.STANDARD_BLOCKS)}, {', '.join(f'({schema.FIRST_PACKAGE_BLOCK + int(str(i), 16)})' for i in range(len(schema.PACKAGE_BLOCKS)))}) t(block_id)")
def block_catalog(spark, d):
    return schema.block_catalog(spark).agg(F.count("*").alias("n_ids"), F.count_if(schema.is_data_block(F.col("block_id"))).alias("n_data"))
