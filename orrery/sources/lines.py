"""Newline-delimited JSON-RPC requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 1 << 20  # bytes of a line, its line break included


def requests(df: DataFrame, line: str, longest: int = LONGEST) -> DataFrame:
    """``df`` with (id, method, params, code, message) of every line's request.

    ``line`` is binary or text.  Lines that are too long or no UTF-8 are parse
    errors (-32700), as is what isn't JSON; JSON that is no request object with
    a method is invalid (-32600).  code and message are null for good ones; a
    request without an id is a notification, its id is null.  Lines of white
    space only are left out.
    """
    raw = F.col(line).cast("binary")
    able = (F.octet_length(raw) <= longest - 1) & F.is_valid_utf8(F.col(line).cast("string"))
    text = F.when(able, F.col(line).cast("string"))
    # a variant is null only for what can't be parsed
    parsed = F.try_parse_json(text)
    field = lambda path, kind: F.try_variant_get(parsed, path, kind)
    method: Column = field("$.method", "string")
    shape = F.schema_of_variant(parsed)
    good = F.startswith(shape, F.lit("OBJECT")) & method.isNotNull() & (F.coalesce(field("$.jsonrpc", "string"), F.lit("")) == "2.0")
    code = F.when(parsed.isNull(), -32700).when(~F.coalesce(good, F.lit(False)), -32600)
    message = F.when(code == -32700, "Parse error").when(code == -32600, "Invalid Request")
    blank = F.coalesce(F.regexp_replace(text, "\\s+", "") == "", F.lit(False))
    return df.where(~blank).withColumns({"id": field("$.id", "string"), "method": F.when(code.isNull(), method), "params": F.when(code.isNull(), field("$.params", "string")), "code": code, "message": message})
