"""The pipeline from raw documents to token ids; its stages are in ``dossierlake.llm.pipeline``."""

from dossierlake.llm.pipeline import (  # noqa: F401
    ORACLE_SQL, STAGES, drop_near_duplicates, drop_repeated_lines, drop_toxic, mix_sources, run, tokenise,
)
