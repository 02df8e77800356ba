"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from . import bpe, decontaminate, divergence, language, media, near, periods, quality, rlz, secrets, suffixes, urls, vectors

QUERIES = {
    "op1_rlz_dedup": rlz.op1_rlz_dedup,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_near_duplicates": near.op5_near_duplicates,
    "op6_language_id": language.op6_language_id,
    "op7_quality": quality.op7_quality,
    "op8_telephony_audio": media.op8_telephony_audio,
    "op9_url_filter": urls.op9_url_filter,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_vector_links": vectors.op11_vector_links,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_periodic_runs": periods.op13_periodic_runs,
}
ORACLE: dict[str, str] = {
    "op1_rlz_dedup": rlz.OP1_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op5_near_duplicates": near.OP5_SQL,
    "op9_url_filter": urls.OP9_SQL,
    "op11_vector_links": vectors.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
}
