"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from . import (
    alignment,
    chat,
    divergence,
    language_model,
    line_crf,
    line_dedup,
    mixing,
    near_dedup,
    order_minhash,
    packing,
    periodic_runs,
    substring,
    token_files,
)
from .common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark, folder):
        return fn(prepare(spark), folder)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file; the library holds none itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_best_fit_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), tokenizer(), max_tokens=4096, end_id=1)


@query
def op4_token_files(spark, folder):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), path, tokenizer(), end_id=2)
    return token_files.token_spans(spark, path)


@query
def op6_line_crf_quality(spark, folder):
    docs = table(spark, folder, "documents")
    field = line_crf.train(docs, table(spark, folder, "labels"))
    return line_crf.score(docs, field)


@query
def op8_source_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


@query
def op10_histogram_divergence(spark, folder):
    return divergence.judge(table(spark, folder, "documents"))


@query
def op7_order_minhash(spark, folder):
    return order_minhash.compare(table(spark, folder, "documents"))


@query
def op9_stupid_backoff(spark, folder):
    return language_model.score(table(spark, folder, "documents"))


ORACLES["op9_stupid_backoff"] = language_model.ORACLE


@query
def op5_substring_dedup(spark, folder):
    return substring.dedup(table(spark, folder, "documents"))


@query
def op2_bag_minhash(spark, folder):
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query
def op3_tool_call_linking(spark, folder):
    calls, results, context = chat.calls_of(table(spark, folder, "conversations"))
    return chat.link(calls, results, chat.TOOLS, context)


@query
def op11_line_dedup(spark, folder):
    return line_dedup.dedup(table(spark, folder, "documents")).drop("dropped")


ORACLES["op11_line_dedup"] = line_dedup.ORACLE


@query
def op13_periodic_runs(spark, folder):
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.planted(table(spark, folder, "documents"))))


@query
def op12_token_alignment(spark, folder):
    files = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    return alignment.compare(table(spark, folder, "documents"), *files)
