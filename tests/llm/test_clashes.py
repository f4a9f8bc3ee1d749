"""Extra columns under the names that operators use themselves, and rows that share an id."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.llm import embeddings, fim, line_chunks, mixing, quality, sentencepiece_bpe, substrings

FOLDER = Path(line_chunks.__file__).parent
NAMES = sorted({n for f in FOLDER.glob("*.py") for n in re.findall(r'"(_[a-z_]+)"', f.read_text()) if n not in ("_lectern_path", "_current")})


def rows(spark):
    same = "one line here\nand another line\nthe third one"
    texts = [(1, same), (2, f"first\n{same}\nlast"), (3, None), (4, ""), (None, same), (2, "other text"), (5, "word " * 60), (6, "word " * 60)]
    return spark.createDataFrame([(k, t, f"src{(k or 0) % 2}") for k, t in texts], "doc_id long, text string, source string")


@pytest.mark.parametrize("operator", [line_chunks.dedup_lines, substrings.remove_repeats, mixing.curriculum_mix, fim.fill_in_middle, quality.classify, lambda df: sentencepiece_bpe.encode(df, MODEL())], ids=["lines", "substrings", "mix", "fim", "quality", "encode"])
def test_columns_of_any_internal_name_stay_as_they_are(spark, operator):
    df = rows(spark).coalesce(1)
    extra = df.withColumns({n: F.concat(F.lit(f"{n} "), F.coalesce("text", F.lit(""))) for n in [*NAMES, "own0", "part", "digest"]})
    plain, got = operator(df), operator(extra)
    assert set(got.columns) == set(plain.columns) | set(NAMES) | {"own0", "part", "digest"}
    key = plain.columns
    assert sorted(map(repr, got.select(*key).collect())) == sorted(map(repr, plain.collect()))
    assert all(r[n].startswith(f"{n} ") for r in got.select(*NAMES).collect() for n in NAMES)


def MODEL():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_vectors_that_share_an_id_have_links_of_their_own(spark):
    near = [1.0, 0.01, 0.0]
    data = [(1, None, 1), (1, [0.0, 0.0, 1.0], 1), (1, [1.0, 0.0, 0.0], 1), (2, near, 1), (3, [0.0, 0.0, 0.0], 1), (3, [float("nan"), 1.0, 0.0], 1), (None, near, 1)]
    got = embeddings.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label long")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, 0, True), (1, 0, 1, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (3, 0, 3, True)]
