"""Thresholds and names that the operators share, as one frozen value."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Params:
    # Fixed values.
    good_r_min: float = 0.6
    medium_misses_max: int = 1
    medium_wrong_bad_eqs_max: int = 1
    g_min: float = 0.5
    r_variant: str = "dup_fraction"
    dup_sim_threshold: float = 0.90
    step_split_sentences: bool = False
    value_match_tol: float = 1e-6
    equation_tol: float = 1e-4
    nr_e_max: float = 0.30
    st_len_ratio: float = 0.6
    st_min_shat: int = 2
    st_e_max: float = 0.60
    sm_e_max: float = 0.30
    ce_e_min: float = 0.30
    v_min: float = 0.40
    v_max: float = 0.85
    full_len_ratio: float = 0.7
    abstain_margin: float = 0.05
    diag_min_confidence: float = 0.0
    normalize_traces: bool = True
    vulgar_spacing: bool = False
    word_boundaries: bool = False
    category_boost: float = 0.15
    shortlist: int = 15
    w_relevance: float = 0.4
    w_complexity: float = 0.6
    diversity_threshold: float = 0.85
    n_shots: int = 8
    exemplar_budget: int | None = None
    repeat_min_len: int = 12
    z: float = 1.96

    def snapshot(self) -> dict:
        """All scalar settings, for the record of a run."""
        return {k: v for k, v in sorted(asdict(self).items()) if v is None or isinstance(v, (bool, int, float, str))}


DEFAULTS = Params()
NAMES = tuple(f.name for f in fields(Params))
