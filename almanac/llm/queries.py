"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import ORACLES, QUERIES, query, table


@query("op5_best_fit_packing")
def op5(spark, d):
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


from .mixing import MIX_SQL, mix


@query("op10_mix_sources", MIX_SQL)
def op10(spark, d):
    return mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_pii_bootstrap")
def op3(spark, d):
    from .pii import digest, find

    return digest(find(table(spark, d, "documents")))


from .licences import scan, scan_sql


@query("op8_licence_diagonals", scan_sql())
def op8(spark, d):
    return scan(table(spark, d, "documents"))


from .warc import WARC_SQL


@query("op7_warc_zip", WARC_SQL)
def op7(spark, d):
    from .warc import round_trip

    return round_trip(table(spark, d, "pages"))


@query("op9_simhash_vantage")
def op9(spark, d):
    from .simhash import digest, near_duplicates

    return digest(near_duplicates(table(spark, d, "documents")))


from .neighbours import NEIGHBOURS_SQL


@query("op1_nn_descent", NEIGHBOURS_SQL)
def op1(spark, d):
    from .neighbours import near_duplicates

    return near_duplicates(table(spark, d, "embeddings"))


from .topk import TOPK_SQL


@query("op4_threshold_topk", TOPK_SQL)
def op4(spark, d):
    from .topk import integer_vectors, search

    return search(integer_vectors(table(spark, d, "embeddings")), F.col("vec_id") % 50 == 0)


@query("op6_suffix_intervals")
def op6(spark, d):
    from .repeats import digest, remove_repeats

    return digest(remove_repeats(table(spark, d, "documents"), texts=False))


@query("op2_toxicity_channel")
def op2(spark, d):
    from .toxicity import classify

    return classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op11_two_pass_shuffle")
def op11(spark, d):
    from .sharding import digest, write_shards

    return digest(write_shards(table(spark, d, "documents")))


from .resampling import RESAMPLE_SQL


@query("op12_importance_resampling", RESAMPLE_SQL)
def op12(spark, d):
    from .resampling import resample

    return resample(table(spark, d, "documents"), table(spark, d, "benchmark"))


from .spelling import SPELLING_SQL


@query("op13_spelling_chunks", SPELLING_SQL)
def op13(spark, d):
    from .spelling import variants

    return variants(table(spark, d, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


__all__ = ["QUERIES", "ORACLES"]
