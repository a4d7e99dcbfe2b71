"""Short texts and their half-edited selves in op2's query."""


def test_op2_short_texts_share_units_with_the_edit_and_long_ones_are_cut_evenly(spark, tmp_path):
    from quantloom.llm.queries import QUERIES

    text = lambda i, n: "".join(chr(97 + (k * k + i * k) % 26) for k in range(n))
    rows = [(1, text(1, 255)), (2, text(2, 70)), (3, text(3, 256)), (4, text(4, 300))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.near_edited for r in QUERIES["op2_iblt_fingerprints"](spark, str(tmp_path)).collect()}
    assert all(x > 0 for x in got.values()) and abs(got[4] - 0.2) < 1e-12  # one unit of three is left
