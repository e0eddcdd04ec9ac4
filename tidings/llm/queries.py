"""All registered queries of the package: importing this module registers them."""

from tidings.llm import (  # noqa: F401
    alignment,
    chunk_dedup,
    grid_join,
    jaccard_join,
    merge_replay,
    mixing,
    nb_svm,
    packing,
    personal_data,
    quality_rules,
    sharding,
    spelling,
    token_files,
)
from tidings.llm.catalog import ORACLES, QUERIES  # noqa: F401
