import pytest

#: Columns that operators use inside; a caller's table may have them too.
CLASHING = (
    "key ids fp label root node number value mask band count first component_id text_sha size source_size target taken place "
    "shuffle cell before within upto finish copy part following after spans score held_out predicted lang_pred fingerprint start "
    "n_tokens rank query_id block rows weights _kept _id _times _copy _fp _hot _n url page_id quality times _print _print_kept "
    "phrase hash f a l r n row base seen added length period runs collapsed all_found email_start id"
).split()


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source[, lang]]) rows, with extra columns of clashing names."""

    def make(rows):
        full = [(*row, *((None, "s0", "en")[len(row) - 1 :] if len(row) > 1 else ())) for row in rows]
        schema = "doc_id bigint, text string, source string, lang string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame([(*r[:4], len(r[1]) if r[1] is not None else None, *(["x"] * len(CLASHING))) for r in full], schema)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null ids and texts, empty and long texts, repeated rows."""
    return make_docs(
        [
            (None, "an entry without id"), (None, None, None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one two three four"), (4, "one two three four"),
            (5, "long text " * 30_000, None), (6, "é" * 5000, "s1", "fr"), (7, "a b   c\x1cd \U0001f600 <|endoftext|>", "", None), (2**62, "x", "s1"), (8, "0 1 2", "s2", "de"),
        ]
    )


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
