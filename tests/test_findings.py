"""Cases that a reviewer found, against the queries' SQL."""

import duckdb
import pytest

from auditlake.plans import catalog


#: Words, sentences and vowel groups of such texts.
HALVES = [(117, 3, 143), (235, 5, 273), (235, 5, 298), (359, 1, 359)]


def against_sql(spark, tmp_path, name, documents):
    """Spark's and DuckDB's rows of a query over documents (doc_id, text)."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in documents]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = catalog.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    return sorted(map(tuple, got)), sorted(want.fetchall())


def test_readability_next_to_a_half(spark, tmp_path):
    texts = [
        # 206.835 - 1.015 * n / s - 84.6 * y / n: its double lies next to a half, on which ten times it falls
        " ".join(["aba"] * (y - n) + ["ab"] * (2 * n - y)) + "." + " x." * (s - 1) for n, s, y in HALVES
    ]
    texts.append("İstanbul ab. " * 20)  # its first letter becomes one of a word
    got, want = against_sql(spark, tmp_path, "readability", list(enumerate(texts)))
    assert got == want


@pytest.mark.parametrize("name", ["jaccard_pairs", "near_duplicate_clusters", "top_pairs"])
def test_groups_of_near_copies(spark, tmp_path, name):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[:k] + ["other"] * (k > 0) + base[k + 1 :]) for k in range(0, 60, 4)]  # one word of each goes
    texts += [" ".join(base), " ".join(base), None, "", "a b", "b a", "a", "İ b"]
    texts += [" ".join(f"v{j}" for j in range(m)) for m in range(40, 60)]  # prefixes of one another
    got, want = against_sql(spark, tmp_path, name, list(enumerate(texts)))
    assert got == want and want


def test_candidates_of_near_copies_come_once_a_run(spark):
    from auditlake.operators import near_duplicates

    texts = [(k, " ".join(f"w{j}" for j in range(400)) + f" end{k}") for k in range(12)]
    sets = near_duplicates.shingle_sets(spark.createDataFrame(texts, "id long, text string"), "id", "text")
    assert near_duplicates.similar(sets, "id").count() == 66
    assert sets.schema["shingles"].dataType.simpleString() == "array<bigint>"
