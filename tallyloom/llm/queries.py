"""Import every operator module; importing registers its query."""

from . import bpe, chat, mih, mixing, near_dedup, ngram_lm, outliers, packing, quality, repair, secret_scan, toxicity, whitening  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
