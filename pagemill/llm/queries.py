"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pagemill.llm import op01_mixing, op02_secrets, op03_quality, op04_media, op05_packing, op06_exact_dedup, op07_pages, op08_backoff, op09_near, op10_licences

QUERIES = {
    "op1_mixing": op01_mixing.query,
    "op2_secrets": op02_secrets.query,
    "op3_quality": op03_quality.query,
    "op4_media": op04_media.query,
    "op5_packing": op05_packing.query,
    "op6_exact_dedup": op06_exact_dedup.query,
    "op7_pages": op07_pages.query,
    "op8_backoff": op08_backoff.query,
    "op9_near": op09_near.query,
    "op10_licences": op10_licences.query,
}
ORACLES = {
    "op2_secrets": op02_secrets.SQL,
    "op8_backoff": op08_backoff.SQL,
    "op9_near": op09_near.SQL,
    "op6_exact_dedup": op06_exact_dedup.SQL,
}
