"""Molecules, chains, residues, atoms and bonds, and what a particle's number means.

Particles are numbered molecule type by type, instance by instance. Prefix sums over the types (one row each) give each type's
span; a number finds its type by a lookup in these spans. As in files' readers, the atom is found by the number modulo the type's atoms;
corrected=True counts from the type's first particle instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import matches
from .frames import locate

#: Instances that one row stands for on its way to a task, and bonds that a task expands.
SPAN, PER_TASK = 16_384, 4_000_000


def spans(molecules: DataFrame) -> DataFrame:
    """molecules with first_particle, n_particles, first_residue (of the type, over the whole file)."""
    before = Window.orderBy("mol_idx").rowsBetween(Window.unboundedPreceding, -1)  # one row for each type
    n, r = F.col("n_atoms") * F.col("cnt"), F.col("n_residues") * F.col("cnt")
    return molecules.select("*", n.alias("n_particles"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias("first_particle"), F.coalesce(F.sum(r).over(before), F.lit(0)).alias("first_residue"))


def particle_to_molecule(particles: DataFrame, molecules: DataFrame, at: str = "particle") -> DataFrame:
    """particles with mol_idx, mol_id, molecule, and place of the type."""
    types = spans(molecules).select("mol_idx", "mol_id", F.col("name").alias("molecule"), "n_atoms", "n_residues", "first_particle", "n_particles", "first_residue")
    return locate(particles, types, at, "first_particle", "n_particles", ["mol_idx", "mol_id", "molecule", "n_atoms", "n_residues", "first_particle", "first_residue"])


def particle_to_atom(particles: DataFrame, molecules: DataFrame, atoms: DataFrame, residues: DataFrame, chains: DataFrame, at: str = "particle", corrected: bool = False) -> DataFrame:
    """particles with names and ids of atom, residue, chain and molecule. Levels that a file leaves out are null; the atom type is then empty."""
    placed = particle_to_molecule(particles, molecules, at)
    start = F.col("first_particle") if corrected else F.lit(0)
    placed = placed.withColumn("atom_idx", (F.col(at) - start) % F.when(F.col("n_atoms") > 0, F.col("n_atoms")))
    names = atoms.select("mol_idx", "atom_idx", "res_idx", F.col("name").alias("atom"), "atom_type")
    names = names.join(residues.select("mol_idx", "res_idx", "res_id", "chain_idx", F.col("name").alias("residue")), ["mol_idx", "res_idx"], "left")
    names = names.join(chains.select("mol_idx", "chain_idx", F.col("name").alias("chain")), ["mol_idx", "chain_idx"], "left")
    found = placed.join(names, ["mol_idx", "atom_idx"], "left")
    whole = F.col("res_id") + F.col("first_residue") + F.col("n_residues") * F.expr(f"({at} - first_particle) div if(n_atoms > 0, n_atoms, null)")
    return found.withColumn("global_residue", whole).withColumn("atom_type", F.coalesce("atom_type", F.lit("")))


def bonds_expanded(molecules: DataFrame, bonds: DataFrame) -> DataFrame:
    """src, dst: bonds of all instances, by particle numbers. Instances come from sequences, not from a join. Few types stand in few partitions,
    so the rows to come are counted first, and spans of instances are dealt to as many tasks as these need before they come apart."""
    types = spans(molecules).where("cnt > 0").select("mol_idx", "n_atoms", "cnt", "first_particle")
    total = bonds.groupBy("mol_idx").agg(F.count("*").alias("_n")).join(types, "mol_idx").agg(F.sum(F.col("_n") * F.col("cnt"))).first()[0] or 0
    last = F.greatest(F.col("cnt") - 1, F.lit(0).cast("long"))  # the sequence may be looked at before the counts are
    each = bonds.join(types, "mol_idx").withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(SPAN).cast("long"))))
    if total > PER_TASK:
        each = each.repartition(-(-total // PER_TASK), "mol_idx", "from_atom", "to_atom", "_from")
    each = each.withColumn("instance", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + SPAN, F.col("cnt")) - 1)))
    start = F.col("first_particle") + F.col("instance") * F.col("n_atoms")
    return each.select("mol_idx", "instance", (start + F.col("from_atom")).alias("src"), (start + F.col("to_atom")).alias("dst"))


def totals(molecules: DataFrame) -> DataFrame:
    return molecules.agg(F.sum("cnt").alias("n_molecules"), F.sum(F.col("n_atoms") * F.col("cnt")).alias("n_particles"))


def totals_by_set(counts: DataFrame, molecules: DataFrame) -> DataFrame:
    """For files whose counts change: totals by frame set."""
    return counts.join(molecules.select("mol_idx", "n_atoms"), "mol_idx").groupBy("frame_set").agg(F.sum("cnt").alias("n_molecules"), F.sum(F.col("n_atoms") * F.col("cnt")).alias("n_particles"))


def find(entities: DataFrame, idx: str, name: str = "", wanted_id: int = -1, id_col: str | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """The last entity that matches, in each group of within. The empty name and the id -1 match all."""
    hits = entities.where(matches(F.col("name"), F.col(id_col or idx), name, wanted_id))
    if not within:
        return hits.orderBy(F.desc(idx)).limit(1)
    last = Window.partitionBy(*within).orderBy(F.desc(idx))
    return hits.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


def nth(entities: DataFrame, idx: str, n: int) -> DataFrame:
    return entities.where(F.col(idx) == n)


def child_counts(molecules: DataFrame, chains: DataFrame, residues: DataFrame, atoms: DataFrame) -> DataFrame:
    """Numbers of chains, residues and atoms of each molecule type."""
    count = lambda rows, n: rows.groupBy("mol_idx").agg(F.count("*").alias(n))
    found = molecules.select("mol_idx")
    for rows, n in ((chains, "n_chains"), (residues, "n_residues"), (atoms, "n_atoms")):
        found = found.join(count(rows, n), "mol_idx", "left")
    return found.na.fill(0)


def atom_of_residue(atoms: DataFrame, n: int) -> DataFrame:
    """The nth atom of each residue."""
    order = Window.partitionBy("mol_idx", "res_idx").orderBy("atom_idx")
    return atoms.withColumn("_nth", F.row_number().over(order) - 1).where(F.col("_nth") == n).drop("_nth")


class Builder:
    """Topology, entity by entity. Ids of molecules and chains start at 1, those of a chain's residues and of a molecule's atoms
    at 0. tables() gives the five tables; residues are numbered chain by chain, whatever order they were added in."""

    def __init__(self) -> None:
        self.molecules: list[dict] = []

    def add_molecule(self, name: str, cnt: int = 0, mol_id: int | None = None) -> int:
        mol_id = mol_id if mol_id is not None else self.molecules[-1]["id"] + 1 if self.molecules else 1
        self.molecules.append({"id": mol_id, "name": name, "cnt": cnt, "chains": [], "residues": [], "atoms": [], "bonds": []})
        return len(self.molecules) - 1

    def set_count(self, mol: int, cnt: int) -> None:
        if cnt < 0:
            raise ValueError("a count can't be negative")
        self.molecules[mol]["cnt"] = cnt

    def add_chain(self, mol: int, name: str, chain_id: int | None = None) -> int:
        chains = self.molecules[mol]["chains"]
        chains.append((chain_id if chain_id is not None else chains[-1][0] + 1 if chains else 1, name))
        return len(chains) - 1

    def add_residue(self, mol: int, chain: int | None, name: str, res_id: int | None = None) -> int:
        residues = self.molecules[mol]["residues"]
        own = [r for r in residues if r[0] == chain]
        residues.append((chain, res_id if res_id is not None else own[-1][1] + 1 if own else 0, name))
        return len(residues) - 1

    def add_atom(self, mol: int, residue: int | None, name: str, atom_type: str, atom_id: int | None = None) -> int:
        atoms = self.molecules[mol]["atoms"]
        atoms.append((residue, atom_id if atom_id is not None else atoms[-1][1] + 1 if atoms else 0, name, atom_type))
        return len(atoms) - 1

    def add_bond(self, mol: int, from_atom: int, to_atom: int) -> None:
        self.molecules[mol]["bonds"].append((from_atom, to_atom))

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """molecules (with cnt), chains, residues, atoms, bonds."""
        out: dict[str, list] = {"molecules": [], "chains": [], "residues": [], "atoms": [], "bonds": []}
        for i, m in enumerate(self.molecules):
            order = sorted(range(len(m["residues"])), key=lambda k: (m["residues"][k][0] if m["residues"][k][0] is not None else -1, k))
            new = {k: at for at, k in enumerate(order)}
            out["molecules"].append((i, m["id"], m["name"], len(m["chains"]), len(m["residues"]), len(m["atoms"]), len(m["bonds"]), m["cnt"]))
            out["chains"] += [(i, k, c, n) for k, (c, n) in enumerate(m["chains"])]
            out["residues"] += [(i, new[k], m["residues"][k][1], m["residues"][k][0], m["residues"][k][2]) for k in order]
            out["atoms"] += [(i, k, a, None if r is None else new[r], n, t) for k, (r, a, n, t) in enumerate(m["atoms"])]
            out["bonds"] += [(i, k, a, b) for k, (a, b) in enumerate(m["bonds"])]
        kinds = {
            "molecules": "mol_idx long, mol_id long, name string, n_chains long, n_residues long, n_atoms long, n_bonds long, cnt long", "chains": "mol_idx long, chain_idx long, chain_id long, name string",
            "residues": "mol_idx long, res_idx long, res_id long, chain_idx long, name string", "atoms": "mol_idx long, atom_idx long, atom_id long, res_idx long, name string, atom_type string", "bonds": "mol_idx long, bond_idx long, from_atom long, to_atom long",
        }
        return {k: spark.createDataFrame(rows, kinds[k]) for k, rows in out.items()}
