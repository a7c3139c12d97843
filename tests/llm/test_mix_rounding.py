"""A source whose target rounds up to a multiple of its size."""

from acquira.llm import mixing


def test_source_mix_target_that_rounds_up_to_the_size(spark):
    rows = spark.createDataFrame([(i, "a b c d", s) for s, n in (("x", 10), ("y", 7)) for i in range(n)], "doc_id long, text string, source string")
    for share, taken in ((0.99, 40), (1.99, 80)):  # 40 words, targets of 39.6 and 79.6
        got = mixing.mix(rows.where("source = 'x'"), weights=(1,), share=share).collect()
        assert sum(r.taken for r in got) == taken and len(got) == 10
