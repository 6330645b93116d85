"""Request and response messages as JSON strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import escape_turtle

# Message types and the wire layout.
REQUEST_TYPE = "EntityMentionResolutionRequest"
RESPONSE_TYPE = "EntityMentionResolutionResponse"
ERROR_TYPE = "EREErrorResponse"
CONTENT_TYPE = "text/turtle"
UNKNOWN_REQUEST = "unknown"
MENTION_ID_LAYOUT = "struct<request_id:string,source_id:string,entity_type:string>"
REQUEST_LAYOUT = (
    f"struct<type:string,entity_mention:struct<identifiedBy:{MENTION_ID_LAYOUT},content:string,content_type:string>,"
    "timestamp:string,ere_request_id:string,_corrupt_record:string>"
)
PREFIX_HEADER = (
    "@prefix org: <http://www.w3.org/ns/org#> .\n"
    "@prefix cccev: <http://data.europa.eu/m8g/> .\n"
    "@prefix epo: <http://data.europa.eu/a4g/ontology#> .\n"
    "@prefix locn: <http://www.w3.org/ns/locn#> .\n"
    "@prefix epd: <http://data.europa.eu/a4g/resource/> .\n"
)
ADDRESS_PREDICATES = {
    "nuts_code": "epo:hasNutsCode",
    "post_code": "locn:postCode",
    "post_name": "locn:postName",
    "thoroughfare": "locn:thoroughfare",
}
PROCESSING_ERROR, CONFLICT_ERROR, VALUE_ERROR = "ProcessingError", "ConflictError", "ValueError"


def parse(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Add the fields of each message, or `parse_error` for malformed, untyped and unsupported ones."""
    message = F.from_json(F.col(column), REQUEST_LAYOUT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    body = raw.withColumn("_m", message)
    kind, ids = F.col("_m.type"), "_m.entity_mention.identifiedBy"
    problem = (
        F.when(F.col("_m._corrupt_record").isNotNull() | F.col("_m").isNull(), "The message is not valid JSON")
        .when(F.coalesce(kind, F.lit("")) == "", "The message has no type")
        .when(kind != REQUEST_TYPE, F.concat(F.lit("Unsupported message type "), kind))
        .when(
            reduce(lambda a, b: a | b, [F.col(f"{ids}.{name}").isNull() for name in ("request_id", "source_id", "entity_type")]),
            "The message identifies no mention: it needs request_id, source_id and entity_type",
        )
    )
    return body.select(
        *raw.columns,
        F.col("_m.entity_mention.identifiedBy.request_id").alias("request_id"),
        F.col("_m.entity_mention.identifiedBy.source_id").alias("source_id"),
        F.col("_m.entity_mention.identifiedBy.entity_type").alias("entity_type"),
        F.col("_m.entity_mention.content").alias("content"),
        F.try_to_timestamp(F.col("_m.timestamp")).alias("created_at"),
        F.coalesce("_m.ere_request_id", F.lit(UNKNOWN_REQUEST)).alias("ere_request_id"),
        problem.alias("parse_error"),
    )


def turtle(mentions_columns: list[str], request_id: Column) -> Column:
    """Turtle description of a mention row; empty address fields are left out."""

    def quoted(name: str) -> Column:
        value = F.coalesce(F.col(name), F.lit("")) if name in mentions_columns else F.lit("")
        return F.concat(F.lit('"'), escape_turtle(value), F.lit('"'))

    optional = [
        F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(f"{predicate} "), quoted(name)))
        for name, predicate in ADDRESS_PREDICATES.items()
        if name in mentions_columns
    ]
    address = F.concat_ws(" ;\n        ", F.concat(F.lit("epo:hasCountryCode "), quoted("country_code")), *optional)
    return F.concat(
        F.lit(PREFIX_HEADER + "\nepd:ent"),
        request_id,
        F.lit(" a org:Organization ;\n    epo:hasLegalName "),
        quoted("legal_name"),
        F.lit(" ;\n    cccev:registeredAddress [\n        "),
        address,
        F.lit("\n    ] ."),
    )


def render(mentions: DataFrame, source_id: Column, created_at: Column) -> DataFrame:
    """Mentions as request messages (request_id, arrival_seq, raw)."""
    request_id = F.col("mention_id")
    body = F.to_json(
        F.struct(
            F.lit(REQUEST_TYPE).alias("type"),
            F.struct(
                F.struct(
                    request_id.alias("request_id"), source_id.alias("source_id"), F.lit("ORGANISATION").alias("entity_type")
                ).alias("identifiedBy"),
                turtle(mentions.columns, request_id).alias("content"),
                F.lit(CONTENT_TYPE).alias("content_type"),
            ).alias("entity_mention"),
            F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            F.concat(request_id, F.lit(":01")).alias("ere_request_id"),
        )
    )
    return mentions.select(request_id.alias("request_id"), "arrival_seq", body.alias("raw"))


def response(candidates: Column, answered_at: Column) -> Column:
    """Resolution response; `candidates` is an array of (cluster_id, score)."""
    entries = F.transform(
        candidates,
        lambda c: F.struct(
            c["cluster_id"].alias("cluster_id"),
            c["score"].alias("confidence_score"),
            c["score"].alias("similarity_score"),
        ),
    )
    return F.to_json(
        F.struct(
            F.lit(RESPONSE_TYPE).alias("type"),
            F.struct("request_id", "source_id", "entity_type").alias("entity_mention_id"),
            entries.alias("candidates"),
            answered_at.alias("timestamp"),
            F.col("ere_request_id"),
        )
    )


def error_response(error_type: Column, detail: Column, answered_at: Column) -> Column:
    """Error response."""
    title = F.when(error_type == PROCESSING_ERROR, "Request processing error").otherwise("Resolution error")
    return F.to_json(
        F.struct(
            F.lit(ERROR_TYPE).alias("type"),
            F.col("ere_request_id"),
            error_type.alias("error_type"),
            title.alias("error_title"),
            detail.alias("error_detail"),
            answered_at.alias("timestamp"),
        )
    )
