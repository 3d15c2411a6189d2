"""Registered queries over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillwatch.functions.text import text_list
from tillwatch.operators import documents as docs, search
from tillwatch.plans.catalog import query
from tillwatch.plans.stages import Stages
from tillwatch.sources.business import Business

SCOPES = ("Internal", "Management")
SEARCHED_TYPES = ("Business Rule", "Policy", "User Guide")


def _choice(values: tuple[str, ...], index: str) -> str:
    return f"element_at(array({text_list(values)}), CAST({index} % {len(values)} AS INT) + 1)"


def files(b: Business) -> DataFrame:
    """Every document as an uploaded file; the name's extension follows its id."""
    names = (".txt", ".md", ".csv", ".json", ".pdf", ".TXT")
    return b.documents().selectExpr(
        "doc_id AS document_id", f"concat('doc-', doc_id, {_choice(names, 'doc_id')}) AS filename",
        "CAST(text AS BINARY) AS content", "concat(source, ' / ', lang) AS title",
        f"{_choice(docs.DOCUMENT_TYPES, 'doc_id')} AS document_type", f"{_choice(docs.ACCESS_SCOPES, 'doc_id')} AS access_scope",
        "date_add(DATE '2026-01-01', CAST(doc_id % 180 AS INT)) AS source_date", "map('lang', lang, 'source', source) AS metadata")


def registered(b: Business) -> DataFrame:
    """The versioned document table, written once per application."""
    return Stages(b).table("documents", lambda: _registered(b))


def _registered(b: Business) -> DataFrame:
    """Text documents with identity, copies and versions (all stored as plain text files); `document_validation` shows the refused ones."""
    texts = Stages(b).table("validated_documents", lambda: docs.validate(
        files(b).selectExpr("*", "'x.txt' AS plain").drop("filename").withColumnRenamed("plain", "filename")).where("outcome = 'valid'"))
    # identity and versions are worked out on narrow rows; the texts are shuffled at most once
    identity = texts.selectExpr("document_id", "checksum_sha256", "injection_matches",
                                f"{docs.logical_key('title')} AS logical_document_key")
    state = docs.versions(docs.first_copies(identity)).select("document_id", "logical_document_key", "version_number", "status")
    return texts.join(state, "document_id")


@query()
def document_validation(b: Business):
    return docs.validate(files(b)).selectExpr(
        "document_id", "file_extension", "file_size_bytes", "checksum_sha256", "length(content_text) AS text_length", "outcome",
        "array_join(injection_matches, ', ') AS injection_matches")


@query()
def injection_scan(b: Business):
    """Flags on every document and on every conversation turn."""
    turns = b.raw("conversations").selectExpr(
        "conv_id AS document_id", "turn", "'turn.txt' AS filename", "CAST(text AS BINARY) AS content")
    both = turns.selectExpr("'turn' AS kind", "*").unionByName(
        files(b).selectExpr("'document' AS kind", "document_id", "CAST(NULL AS BIGINT) AS turn", "filename", "content"))
    return docs.validate(both).selectExpr("kind", "document_id", "turn", "size(injection_matches) AS matches",
                                          "array_join(injection_matches, ', ') AS injection_matches")


@query()
def logical_keys(b: Business):
    return files(b).selectExpr("document_id", f"{docs.logical_key('title')} AS logical_document_key")


@query()
def vocabulary_check(b: Business):
    """Sources and languages are no document types or scopes, so each shows up as a violation."""
    return docs.vocabulary_check(b.documents().selectExpr("source AS document_type", "lang AS access_scope", "'Active' AS status"))


@query()
def duplicate_documents(b: Business):
    texts = docs.validate(files(b))
    return docs.first_copies(texts).where("duplicate").select("document_id", "original_id", "checksum_sha256")


@query()
def document_versions(b: Business):
    return registered(b).select("document_id", "logical_document_key", "version_number", "status")


def stored_chunks(b: Business) -> DataFrame:
    """The chunks of all registered documents, cut once."""
    return Stages(b).table("chunks", lambda: docs.chunks(registered(b).repartition("document_id")))


@query()
def document_chunks(b: Business):
    return docs.cited(stored_chunks(b), registered(b)).drop("problem")


@query()
def document_list(b: Business):
    found = registered(b).selectExpr(
        "document_id", "title", "document_type", "access_scope", "version_number", "status", "source_date AS updated_at")
    return docs.document_list(found, stored_chunks(b), SCOPES, limit=500)


def search_queries(b: Business) -> DataFrame:
    """Every sentence of every benchmark passage."""
    return b.raw("benchmark").selectExpr("item_id", "posexplode(split(text, '[.!?]')) AS (place, query)").where(
        "trim(query) <> ''").selectExpr("concat_ws('-', item_id, place) AS query_id", "query")


def search_all(b: Business, limit: int) -> DataFrame:
    units = searched_units(b)
    index = Stages(b).table("document_index", lambda: docs.postings(units, "text"))
    return docs.search(units, search_queries(b), limit, index)


def searched_units(b: Business) -> DataFrame:
    return docs.searchable(registered(b), SCOPES, date_from="2026-01-01", date_to="2026-06-30").selectExpr(
        "document_id AS unit_id", "content_text AS text")


@query()
def document_search(b: Business):
    return search_all(b, 20)


def search_forms(b: Business) -> DataFrame:
    """Five queries from the words of every benchmark passage: words, a phrase, alternatives, exclusions, and all of these."""
    words = rf"regexp_extract_all(lower(text), '{docs.WORD}', 0)"
    forms = {
        0: "concat_ws(' ', w[0], w[1], w[2])", 1: "concat('\"', concat_ws(' ', w[0], w[1], w[2]), '\"')",
        2: "concat(w[0], ' ', w[1], ' or \"', w[2], ' ', w[3], '\"')", 3: "concat(w[0], ' -', w[1])",
        4: "concat('\"', w[1], ' ', w[2], '\" -\"', w[4], ' ', w[5], '\" OR ', w[3], ' ', w[6])",
    }
    listed = ", ".join(f"struct({k} AS form, {sql} AS query)" for k, sql in forms.items())
    return b.raw("benchmark").selectExpr("item_id", f"{words} AS w").where("size(w) >= 7").selectExpr(
        "item_id", f"inline(array({listed}))").selectExpr("concat_ws('-', item_id, form) AS query_id", "query")


@query()
def stemmed_search(b: Business):
    """English full-text search with stems, phrases, alternatives and exclusions, ranked by cover density."""
    index = Stages(b).table("stem_index", lambda: search.index(searched_units(b)))
    words = Stages(b).table("stem_words", lambda: search.dictionary(index))
    return search.search(index, words, search_forms(b), 20)


@query()
def chunk_search(b: Business):
    """Search over chunks with citations, restricted to English documents of three types."""
    found = docs.searchable(registered(b), SCOPES, types=SEARCHED_TYPES, metadata={"lang": "en"})
    pieces = docs.cited(stored_chunks(b), found)
    units = Stages(b).table("chunk_units", lambda: pieces.selectExpr("citation_id AS unit_id", "chunk_text AS text"))
    index = Stages(b).table("chunk_index", lambda: docs.postings(units, "text"))
    return docs.search(units, search_queries(b), 5, index)


@query()
def retrieval_log(b: Business):
    results = search_all(b, 20)
    return docs.retrieval_log(search_queries(b), results, "unit_id", SCOPES)
