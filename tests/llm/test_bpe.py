import hashlib

import pytest

from lodestone.llm import blocks, bpe
from lodestone.llm import queries as Q


def brute(rows):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def test_query_matches_library(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, Q.op7_bpe(spark, sf_dir).collect()), key=str) == brute(rows)


HARD = [
    "", None, " \t\n", "It's  I'LL we'd 1234 ...!!! <|endoftext|>x<|startoftext|>", "é Å  nb sp  em​zero \x1cfs\x1e\x85nel",
    "ΑΣ ΟΔΟΣ İstanbul ß STRASSE 한 한 Ω ﬁ", "x" * 30_000, "emoji 👩‍👩‍👧 🇩🇪 text", "a'b 's 't're", "́start 　wide line",
]


def test_hard_texts_ties_and_small_blocks(spark, monkeypatch):
    rows = [(i, t, i, "x") for i, t in enumerate(HARD)] + [(3, HARD[3], 0, ""), (None, "null id", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, block string").repartition(3)
    definition = Q.word_bpe()
    got = bpe.decode(bpe.encode(docs, definition), definition).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(((r.id, r.n_tokens, sha(r.ids_text), sha(r.text)) for r in got), key=str) == brute([r[:2] for r in rows])
    small = bpe.map_ids(docs, definition, lambda ids, flat, ends: __import__("pyarrow").RecordBatch.from_pydict({"n": [len(flat)]}), "n long", blocks=blocks.write_blocks(docs, block_bytes=10))
    assert sum(r.n for r in small.collect()) == sum(r[1] for r in brute([r[:2] for r in rows]))


def test_empty_table_and_refused_tokenizer(spark, tmp_path):
    import public_tokenizers

    definition = Q.word_bpe()
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), definition).count() == 0
    with pytest.raises(ValueError):
        bpe.read_definition(public_tokenizers.path("byte_bpe_50k.json"))
