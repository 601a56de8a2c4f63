"""Queries of the training-data operators, keyed pN_... for problem N."""

from __future__ import annotations

from ..sources.tables import read_table, settled, spread
from . import binpack, bpe, language, lookalike, nearcopies, overlap, sentences, varied


def p1_found(spark, sf_dir):
    """One row per sentence of every article: where it ends."""
    return sentences.sentence_ends(spread(read_table(spark, sf_dir, "articles").select("row_id", "article")))


def p1_lists(spark, sf_dir):
    """The sentences of every article, rebuilt as a list."""
    return sentences.sentence_lists(spread(read_table(spark, sf_dir, "articles").select("row_id", "article")))


def p2_found(spark, sf_dir):
    """Pairs of rows whose articles are near-duplicates."""
    articles = spread(read_table(spark, sf_dir, "articles").select("row_id", "article"))
    return nearcopies.near_pairs(articles).select("row_a", "row_b")


def p2_classes(spark, sf_dir):
    """Every article with its class of equal ones and the number of its near-duplicates."""
    articles = spread(read_table(spark, sf_dir, "articles").select("row_id", "article"))
    return nearcopies.near_classes(articles)


def p3_found(spark, sf_dir):
    """Pairs of rows whose article or highlights read the same in other code points."""
    return lookalike.same_reading(spread(read_table(spark, sf_dir, "articles").select("row_id", "article", "highlights")))


def p3_forms(spark, sf_dir):
    """Every article and highlights in the consistent form."""
    table = read_table(spark, sf_dir, "articles").select("row_id", "article", "highlights")
    return lookalike.forms_of(spread(table), "row_id", ["article", "highlights"])


def _evaluated(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "articles").select("row_id", "article", "highlights", "split_name", "source"))


def _overlaps(spark, sf_dir):
    return overlap.overlaps(_evaluated(spark, sf_dir))


def p4_found(spark, sf_dir):
    """Pairs of a training row and an evaluation row whose article or highlights overlap."""
    return overlap.overlap_pairs(_overlaps(spark, sf_dir))


def p4_counts(spark, sf_dir):
    """Overlaps counted by evaluation split and source, with the united coverage of their rows."""
    return overlap.overlap_counts(_overlaps(spark, sf_dir), overlap.coverages(_evaluated(spark, sf_dir)))


def p4_coverage(spark, sf_dir):
    """Share of every evaluation value that stands in the training rows."""
    return overlap.coverages(_evaluated(spark, sf_dir))


def _subsets(spark, sf_dir):
    requests = read_table(spark, sf_dir, "subset_sizes")
    base = varied.records(
        spread(read_table(spark, sf_dir, "processed").select("id", "sentences")),
        read_table(spark, sf_dir, "articles").select("id", "split_name", "source"),
        read_table(spark, sf_dir, "predictions").select("run_id", "id", "selected_indices"),
        requests,
    )
    return varied.subsets(base, requests), base


def p5_subsets(spark, sf_dir):
    """The sentences chosen for every request, with the share of predictions that chose them too."""
    return _subsets(spark, sf_dir)[0]


def p5_comparison(spark, sf_dir):
    """Coverage and redundancy of the chosen sentences against those of the predictions."""
    return varied.comparison(*_subsets(spark, sf_dir))


def p5_scope_comparison(spark, sf_dir):
    """Coverage of whole scopes by the chosen sentences and by the most predicted ones."""
    picked, base = _subsets(spark, sf_dir)
    return varied.scope_comparison(picked, base, varied.whole_scopes(read_table(spark, sf_dir, "subset_sizes")))


def p6_ids(spark, sf_dir):
    """Token ids of every document."""
    return bpe.encode_ids(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def p6_decoded(spark, sf_dir):
    """Every document's text again, decoded from its token ids."""
    return bpe.decode_ids(p6_ids(spark, sf_dir))


def p7_containers(spark, sf_dir):
    """Every document assigned to containers of every capacity by its token count."""
    sizes = settled(bpe.count_ids(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))))
    return binpack.containers(sizes, read_table(spark, sf_dir, "capacities"))


def p7_usage(spark, sf_dir):
    """Containers, lower bound by volume and unused share of every capacity."""
    return binpack.usage(p7_containers(spark, sf_dir), read_table(spark, sf_dir, "capacities"))


def p8_languages(spark, sf_dir):
    """Every stretch of every document with its language, place and confidence."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = language.names_of([(r.lang, r.lang_title) for r in read_table(spark, sf_dir, "languages").collect()])  # a table that does not grow
    return language.languages(spread(documents), language.train(documents, named=named), named=named)


def p8_found(spark, sf_dir):
    """The stretches of documents in several languages or with a missing or wrong label."""
    return p8_languages(spark, sf_dir).where("is_case").select("doc_id", "seg_no", "lang")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_lists, p2_found, p2_classes, p3_found, p3_forms, p4_found, p4_counts, p4_coverage, p5_subsets, p5_comparison, p5_scope_comparison, p6_ids, p6_decoded, p7_containers, p7_usage, p8_found, p8_languages)}


def oracle_sql() -> dict:
    """None of these operators can be stated in SQL; tests/llm holds them against brute force."""
    return {}
