"""The canonical tables of a trajectory.

A frame is a row and a frame set a partition; blocks of a kind are told apart by block_id, a partition column. Absent values are
null. Values are doubles, whatever their type on disk.
"""

from __future__ import annotations

GENERAL_INFO = (
    "program_first string, program_last string, user_first string, user_last string, computer_first string, computer_last string, pgp_first string, pgp_last string, "
    "forcefield string, created long, var_num_atoms boolean, frames_per_set long, medium_stride long, long_stride long, distance_unit_exp long"
)
MOLECULES = "mol_idx long, mol_id long, name string, quaternary long, n_chains long, n_residues long, n_atoms long, n_bonds long"
MOLECULE_COUNTS = "frame_set long, mol_idx long, cnt long"
CHAINS = "mol_idx long, chain_idx long, chain_id long, name string"
RESIDUES = "mol_idx long, res_idx long, res_id long, chain_idx long, name string"
ATOMS = "mol_idx long, atom_idx long, atom_id long, res_idx long, name string, atom_type string"
BONDS = "mol_idx long, bond_idx long, from_atom long, to_atom long"
FRAME_SETS = "frame_set long, first_frame long, n_frames long, first_time double, time_per_frame double, n_particles long"
MAPPINGS = "frame_set long, local_particle long, real_particle long"
DATA_BLOCKS = "block_id long, frame_set long, name string, dtype string, dependency int, first_frame_with_data long, n_frames long, stride long, n_values long, codec int, multiplier double, hash_ok boolean"
PARTICLE_VALUES = "block_id long, frame_set long, frame long, particle long, values array<double>"
FRAME_VALUES = "block_id long, frame_set long, frame long, values array<double>"

FRAMES_PER_SET, MEDIUM_STRIDE, LONG_STRIDE = 100, 5, 25
DEPENDS_ON_FRAME, DEPENDS_ON_PARTICLE = 1, 2
#: A name or other short string has at most so many bytes, its end included.
MAX_STRING = 1024

#: Ids of blocks, as files hold them.
GENERAL_INFO_BLOCK, MOLECULES_BLOCK, FRAME_SET_BLOCK, MAPPING_BLOCK = 0, 1, 2, 3
BOX_SHAPE, POSITIONS, VELOCITIES, FORCES = 0x10000000, 0x10000001, 0x10000002, 0x10000003
PARTIAL_CHARGES, FORMAL_CHARGES, B_FACTORS, ANISOTROPIC_B_FACTORS = 0x10000004, 0x10000005, 0x10000006, 0x10000007
OCCUPANCY, GENERAL_COMMENTS, MASSES = 0x10000008, 0x10000009, 0x10000010
STANDARD_BLOCKS = {
    GENERAL_INFO_BLOCK: "GENERAL INFO", MOLECULES_BLOCK: "MOLECULES", FRAME_SET_BLOCK: "TRAJECTORY FRAME SET", MAPPING_BLOCK: "PARTICLE MAPPING",
    BOX_SHAPE: "BOX SHAPE", POSITIONS: "POSITIONS", VELOCITIES: "VELOCITIES", FORCES: "FORCES", PARTIAL_CHARGES: "PARTIAL CHARGES", FORMAL_CHARGES: "FORMAL CHARGES",
    B_FACTORS: "B-FACTORS", ANISOTROPIC_B_FACTORS: "ANISOTROPIC B-FACTORS", OCCUPANCY: "OCCUPANCY", GENERAL_COMMENTS: "GENERAL COMMENTS", MASSES: "ATOM MASSES",
}


def is_data_block(block_id):
    """Ids from the box shape on are data. Works on numbers and columns."""
    return block_id >= BOX_SHAPE


#: Names of the simulation package's blocks, in the order of their ids (decimal digits in hexadecimal places).
PACKAGE_BLOCKS = (
    "LAMBDA ANGLE RYCKAERT_BELL LJ14 COULOMB14 LJ_SR COULOMB_SR COUL_RECIP POTENTIAL KINETIC_EN TOTAL_ENERGY TEMPERATURE PRESSURE CONSTR_RMSD CONSTR2_RMSD "
    "BOX_X BOX_Y BOX_Z BOX_XX BOX_YY BOX_ZZ BOX_YX BOX_ZX BOX_ZY BOXVEL_XX BOXVEL_YY BOXVEL_ZZ BOXVEL_YX BOXVEL_ZX BOXVEL_ZY VOLUME DENSITY PV ENTHALPY "
    "VIR_XX VIR_XY VIR_XZ VIR_YX VIR_YY VIR_YZ VIR_ZX VIR_ZY VIR_ZZ SHAKEVIR_XX SHAKEVIR_XY SHAKEVIR_XZ SHAKEVIR_YX SHAKEVIR_YY SHAKEVIR_YZ SHAKEVIR_ZX SHAKEVIR_ZY SHAKEVIR_ZZ "
    "FORCEVIR_XX FORCEVIR_XY FORCEVIR_XZ FORCEVIR_YX FORCEVIR_YY FORCEVIR_YZ FORCEVIR_ZX FORCEVIR_ZY FORCEVIR_ZZ PRES_XX PRES_XY PRES_XZ PRES_YX PRES_YY PRES_YZ PRES_ZX PRES_ZY PRES_ZZ "
    "SURFXSURFTEN MUX MUY MUZ VCOS VISC BAROSTAT T_SYSTEM LAMB_SYSTEM SELECTION_GROUP_NAMES ATOM_SELECTION_GROUP"
).split()
FIRST_PACKAGE_BLOCK = 0x1000000010000000


def block_catalog(spark):
    """block_id, name, family of all known ids; a small dimension."""
    rows = [(k, v, "standard" if k >= BOX_SHAPE else "structure") for k, v in STANDARD_BLOCKS.items()]
    rows += [(FIRST_PACKAGE_BLOCK + int(str(i), 16), name, "package") for i, name in enumerate(PACKAGE_BLOCKS)]
    return spark.createDataFrame(rows, "block_id long, name string, family string")
