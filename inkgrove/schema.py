"""Row types of the engine, its codes and its limits."""

from __future__ import annotations

from pyspark.sql import types as T

#: Prefix of links to embedded media; the grammar behind it is part/<path>, obj/<id>/<gen> or page/<n>.
SCHEME = "grove://"
_NAME = r"(?!\.{1,2}(?:/|$))[A-Za-z0-9\-_.]+"
#: A link to embedded media, to be matched as a whole: an office part, a PDF object and its generation, a PDF page.
MEDIA_LINK = rf"{SCHEME}(?:(?:docx/part/word|pptx/part/ppt|xlsx/part/xl)/media/{_NAME}(?:/{_NAME})*|pdf/obj/(0|[1-9]\d{{0,9}})/(0|[1-9]\d{{0,4}})|pdf/page/([1-9]\d{{0,8}}))"
TABLE_SCHEMA_VERSION = "grove-table-json-1"
TABLE_USAGE = "Tables show their first 100 rows of each sheet. Narrow or page with sheet, rows first:last, columns, limit and offset; rows excludes limit and offset."

# Formats, codes and limits of the engine.
FORMATS = ("url", "html", "markdown", "pdf", "docx", "xlsx", "pptx", "csv", "ipynb", "epub", "text")
TABLE_FORMATS = ("csv", "xlsx")
FORMAT_NAMES = {
    "html": "html", "htm": "html", "markdown": "markdown", "md": "markdown", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "xlsm": "xlsx",
    "pptx": "pptx", "csv": "csv", "tsv": "csv", "ipynb": "ipynb", "epub": "epub", "text": "text", "txt": "text",
}
TEXT_EXTENSIONS = ("txt", "log", "rs", "py", "js", "ts", "go", "json", "yaml", "yml", "toml", "xml", "sh", "c", "cpp", "h", "java")
EXTENSIONS = {k: v for k, v in FORMAT_NAMES.items() if k not in ("text", "txt")} | dict.fromkeys(TEXT_EXTENSIONS, "text")
ERROR_CODES = (
    "pdf_no_extractable_content", "parse_budget_exceeded", "work_budget_exceeded", "unsupported_format",
    "encrypted_pdf", "legacy_or_encrypted_office", "invalid_container", "parse_failed",
)
WARNING_CODES = (
    "pdf_page_no_text_layer", "pdf_page_suspicious_text_layer", "pdf_multi_column_reading_order",
    "merged_table_structure_not_preserved", "embedded_visuals_omitted", "vector_graphics_omitted",
)
MAX_PARSE_BYTES = 64 << 20
MAX_ZIP_ENTRIES, MAX_ENTRY_BYTES, MAX_ZIP_RATIO = 10_000, 50 << 20, 200
MAX_OUTPUT_BYTES = 256 << 10
PREVIEW_ROWS, MARKDOWN_RECORDS = 100, 1000
SNIFF_LINES, HEADER_ROWS, LONG_CELL = 20, 20, 40
SNIFF_BYTES = 4096
VECTOR_CURVES = 20
SEARCH_TOP, SNIPPET = 24, 700
LISTED_FAILURES = 20


class ParseError(Exception):
    """A failure with a stable code; every parser raises only this or is wrapped in it."""

    REASONS = {
        "pdf_no_extractable_content": ("the PDF has neither text nor images", "read its pages with a vision model", True, "parse"),
        "parse_budget_exceeded": ("the input or its output is larger than allowed", "narrow the input or raise max_parse_bytes", True, "limits"),
        "work_budget_exceeded": ("the input needs more work than allowed", "raise max_work_units", True, "parse"),
        "unsupported_format": ("the format is not recognised", "this format is not supported", True, "detect"),
        "encrypted_pdf": ("the PDF is encrypted", "remove its password and try again", False, "parse"),
        "legacy_or_encrypted_office": ("an old or encrypted Office format", "remove the password, or save it as docx, xlsx or pptx", False, "detect"),
        "invalid_container": ("the container is damaged or of another kind", "check that the file is complete", True, "parse"),
        "parse_failed": ("the input could not be parsed", "check that the file is valid", True, "parse"),
    }

    def __init__(self, code: str, detail: str = "", stage: str | None = None):
        reason, self.hint, self.recoverable, own = self.REASONS[code]
        self.code, self.stage = code, stage or own
        self.reason = f"{reason}: {detail}" if detail else reason
        super().__init__(self.reason)

    def row(self) -> dict:
        return {"code": self.code, "reason": self.reason, "hint": self.hint, "recoverable": self.recoverable, "stage": self.stage}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
ERROR = _struct(code=_S, reason=_S, hint=_S, recoverable=_B, stage=_S)
WARNING = _struct(code=_S, message=_S, loc_kind=_S, loc_number=_I)
SPAN = _struct(out_start=_L, out_end=_L, source_kind=_S, page_number=_I)
MEDIA = _struct(uri=_S, ordinal=_I, page=_I, extractable=_B)
STATS = _struct(input_bytes=_L, output_bytes=_L, page_count=_I)
HEADER = _struct(column_index=_I)
ROW_RANGE = _struct(first_row=_L, last_row=_L)
TABLE = _struct(
    source=_S, format=_S, sheet=_S, workbook_sheets=T.ArrayType(_S), delimiter=_S, title=_S, range=_S, column_count=_I, header_row=_I,
    headers=T.MapType(_S, HEADER), preamble=_struct(row=_I, content=T.MapType(_S, _S)), rows=T.ArrayType(T.MapType(_S, _S)),
    row_numbers=T.ArrayType(_L), row_range=ROW_RANGE, truncated=_B, warnings=T.ArrayType(_S),
)
PARSED = _struct(
    doc_id=_S, source=_S, format=_S, kind=_S, markdown=_S, tables=T.ArrayType(TABLE), serialized_bytes=_L, warnings=T.ArrayType(WARNING), stats=STATS,
    provenance=T.ArrayType(SPAN), media=T.ArrayType(MEDIA), error=ERROR,
)
