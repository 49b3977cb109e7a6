"""Schemas of the tables that operators exchange."""

from pyspark.sql import types as T


KINDS = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}
SECTION_TYPE = T.ArrayType(T.StructType([
    T.StructField("heading", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("heading_path", KINDS["array<string>"]),
    T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))),
]))
SECTION_DDL = SECTION_TYPE.simpleString()


def schema(fields: str) -> T.StructType:
    """A schema of plain types, without a session."""
    out = T.StructType()
    for field in fields.split(", "):
        name, kind = field.split(" ")
        out.add(name, KINDS[kind])
    return out


SOURCES = schema("url string, scheme string, scheme_name string, category string")
FETCHED = schema("url string, scheme string, scheme_name string, category string, status int, content_type string, n_bytes int, fetched_at string, elapsed_ms double, attempts int, cached boolean, html_path string")
BLOCK = schema("kind string, text string")
DOCUMENTS = schema("doc_id string, title string, scheme string, scheme_name string, category string, source_url string, fetched_at string").add("sections", SECTION_TYPE)
CHUNKS = schema("chunk_id string, text string, scheme string, scheme_name string, category string, section string, source_url string, fetched_at string, heading_path array<string>, n_tokens int, block_types string")
HITS = schema("query_id string, rank int, chunk_id string, text string, section string, scheme string, scheme_name string, category string, source_url string, fetched_at string, heading_path array<string>, distance double")
INDEX_META = schema("embed_model string, embed_dim int, embed_window int, space string, corpus_built_at string")
REFUSALS = ("advice", "pii", "performance", "out_of_corpus")
