from catalog import q_clean, q_exact, q_explore, q_models  # noqa: F401
from catalog.registry import ORACLES, QUERIES  # noqa: F401
