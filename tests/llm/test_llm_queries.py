import pytest
from oracle import check

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_line_dedup", "op6_jaccard_join"])
def test_against_sql(spark, name):
    from revlake.llm.queries import oracle_sql, queries

    check(spark, SMALL, queries()[name], oracle_sql()[name])


def test_contract_columns(spark):
    from revlake.llm.queries import queries

    want = {
        "op1": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op2": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op3": ["doc_id", "held_out", "score", "predicted"],
        "op5": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op6": ["doc_id", "n_shingles", "component_id"],
        "op7": ["vec_id", "n_links", "component_id", "kept"],
        "op8": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op9": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op10": ["page_id", "url", "text", "n_chars"],
    }
    for name, query in queries().items():
        columns = want.get(name.split("_")[0])
        if columns and name.split("_")[0] in ("op3", "op5", "op8", "op10"):
            assert query(spark, SMALL).columns[: len(columns)] == columns
