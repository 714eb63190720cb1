"""Fragments of DuckDB SQL shared by the oracles."""

from __future__ import annotations

from quillmesh.operators.tokens import BOS, EOS, FIRST_ID, PIECE, VOCAB_SIZE

def text(value: str) -> str:
    """A Python string as an SQL literal (line breaks by chr(10))."""
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def strip(x: str) -> str:
    plain = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"trim({x}, {plain})"


def pieces(x: str) -> str:
    return f"regexp_extract_all({x}, '{PIECE}')"


def encode(x: str, vocab_size: int = VOCAB_SIZE) -> str:
    number = "('0x' || substr(md5(p), 1, 8))::BIGINT"
    return f"list_transform({pieces(x)}, lambda p: {FIRST_ID} + {number} % {vocab_size})"


def with_bos(ids: str) -> str:
    return f"CASE WHEN {ids}[1] = {BOS} THEN {ids} ELSE list_concat([{BOS}::BIGINT], {ids}) END"


def with_eos(ids: str) -> str:
    return f"CASE WHEN {ids}[-1] = {EOS} THEN {ids} ELSE list_concat({ids}, [{EOS}::BIGINT]) END"


def specials(ids: str) -> str:
    """Ids hashed from text start at FIRST_ID, so both specials are always missing."""
    return f"list_concat([{BOS}::BIGINT], {ids}, [{EOS}::BIGINT])"


def repeat(value: int, times: str) -> str:
    return f"list_transform(range(greatest({times}, 0)), lambda r: {value}::BIGINT)"


def joined(ids: str) -> str:
    return f"array_to_string({ids}, ',')"


def shuffled(key: str, seed: int) -> str:
    return f"md5('{seed}:' || {key}::VARCHAR)"
