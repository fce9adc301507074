import duckdb
import pytest
from tarn.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())


CONTRACTS = {
    "op1": ["page_id", "url", "text", "n_chars"],
    "op2": ["doc_id", "size", "source_size", "target", "taken"],
    "op3": ["doc_id", "n_shingles", "component_id"],
    "op4": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op6": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op7": ["doc_id", "held_out", "lang_pred", "score"],
    "op8": ["doc_id", "text", "n_sentences", "n_removed"],
    "op9": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op11": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op12": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op13": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
}
KINDS = {"size": "bigint", "taken": "bigint", "target": "double", "score": "double", "kept": "boolean", "base_failed": "boolean", "held_out": "boolean", "over_limit": "boolean", "n_chars": "bigint", "tail_crc32": "bigint", "n": "bigint", "prefix_chars": "bigint", "middle_chars": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    want = CONTRACTS[name.split("_")[0]]
    assert df.columns[: len(want)] == want
    kinds = dict(df.dtypes)
    for c in want:
        if c in KINDS or c.startswith("n_"):
            assert kinds[c] == KINDS.get(c, "bigint"), c
