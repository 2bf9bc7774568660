"""Every query of this subpackage, registered on import."""

from . import q_ann, q_chat, q_decontamination, q_jaccard, q_lattice, q_mixing, q_outliers, q_packing, q_quality, q_resampling, q_secrets, q_spelling, q_substrings
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
