"""Explicit schemas of stored documents; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BOX = struct(x0=_D, y0=_D, x1=_D, y1=_D)
CELL = struct(column_ordinal=_I, source_column_index=_I, raw=_S, parsed_number=_D, unit_original=_S, value_yuan=_D, cell_role=_S, context_source_page=_I, currency=_S, cell_state=_S)
COLUMN = struct(ordinal=_I, source_column_index=_I, header_raw=_S, year=_S, scope=_S, restated=_B, period_label=_S, measure=_S)
ROW = struct(
    row_order=_I, page=_I, block_id=_S, raw_item=_S, normalized_item=_S, row_type=_S, row_level=_I, parent_section=_S, cells=T.ArrayType(CELL), row_role=_S, bbox=BOX,
    observation_type=_S, derived_status=_S, table_block_id=_S, block_order=_I, classification_axis=_S, excluded_from_table_logic=_B, physical_segment_id=_S,
)
CAPTURE_RESULT = struct(
    capture_id=_S, pdf_name=_S, pdf_sha256=_S, table_query=_S, note_number=_S, located_title=_S, start_page=_I, end_page=_I, pages=T.ArrayType(_I), unit=_S,
    columns=T.ArrayType(COLUMN), rows=T.ArrayType(ROW), warnings=T.ArrayType(_S), stats=_S, boundary_status=_S, header_dimension_status=_S,
)
OBS_LONG = struct(
    capture_run_id=_S, company=_S, document_year=_S, table_family=_S, member_table=_S, member_table_role=_S, row_order=_I, row_type=_S, parent_section=_S, raw_item=_S, normalized_item=_S,
    row_path=_S, source_key=_S, column_ordinal=_I, data_year=_S, statement_scope=_S, restated_flag=_B, period_type=_S, currency=_S, unit=_S, measure=_S, value_raw=_S, value=_D, page=_I,
)
REVIEW = struct(pdf_sha256=_S, pdf_name=_S, metric_input=_S, review_status=_S, chosen_primary_value=struct(parsed_number=_D, value_yuan=_D, raw=_S, unit_original=_S), timestamp=_S, note=_S)
TAXONOMY_ENTRY = struct(canonical_section=_S, canonical_item=_S, category=_S, source_keys=T.ArrayType(_S))
RULE = struct(aliases=T.ArrayType(_S), soft_aliases=T.ArrayType(_S), keywords=T.ArrayType(_S), exclude=T.ArrayType(_S), table_hint=T.ArrayType(_S), position_hint=_S, value_type=_S)
MANIFEST = struct(merge_id=_S, table_id=_S, sources=T.ArrayType(struct(capture_run_id=_S, company=_S, document_year=_S, pdf_name=_S)), created_at=_S)
EVENT = struct(event_id=_S, event_type=_S, entity_id=_S, payload=_S, at=T.TimestampType())
PAGE_INDEX = struct(pdf_sha256=_S, config_key=_S, page=_I, text=_S, text_chars=_I, source=_S, ocr_used=_B)
