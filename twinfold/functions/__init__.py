from .minhash import band_shape, jaccard_est, jaccard_exact, token_hash  # noqa: F401
from .phonetic import metaphone  # noqa: F401
from .scores import (  # noqa: F401
    DATE_FORMATS, abs_diff, clip_nonneg, days_between, lev_sim, micros, parse_date, weighted_mean, words,
)
from .tokens import lcs_lengths, set_ratio, token_set  # noqa: F401
