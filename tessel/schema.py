"""Declared types of files, surfaces and changes, and the change kinds."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k.rstrip("_"), v) for k, v in fields.items()])


POINT = _struct(row=T.LongType(), column=T.LongType())
RANGE = _struct(start_byte=T.LongType(), end_byte=T.LongType(), start_point=POINT, end_point=POINT)
TOKEN = _struct(text_normalized=T.StringType(), source_range=RANGE)
PARAM = _struct(name=TOKEN, type_annotation=TOKEN, default_value=TOKEN, optional=TOKEN, rest=TOKEN)
METHOD = T.StructType([T.StructField("async", TOKEN), T.StructField("parameters", T.ArrayType(PARAM, False)), T.StructField("return_type", TOKEN)])
PROP = _struct(type_annotation=TOKEN, required=TOKEN)
SIGNATURE = _struct(kind=T.StringType(), ts_method=METHOD, vue_prop=PROP)
#: One public surface. file_path, source_token and fqn are never null.
SURFACE = _struct(file_path=T.StringType(), source_token=TOKEN, fqn=T.StringType(), signature=SIGNATURE)
#: A surface as extracted: seq orders those of one file.
EXTRACTED = T.StructType([*SURFACE.fields, T.StructField("seq", T.LongType())])
CHANGE = _struct(surface=SURFACE, kind=T.StringType(), old=TOKEN, new=TOKEN)

# Change kinds and their display codes
CODES = {
    "TsMethodAsyncChanged": "ts:method:async:changed",
    "TsMethodParamBecameRequired": "ts:method:param:became:required",
    "TsMethodParamRemoved": "ts:method:param:removed",
    "TsMethodParamRestChanged": "ts:method:param:rest:changed",
    "TsMethodParamTypeChanged": "ts:method:param:type:changed",
    "TsMethodRequiredParamAdded": "ts:method:required:param:added",
    "TsMethodReturnTypeChanged": "ts:method:return:type:changed",
    "VuePropBecameRequired": "vue:prop:became:required",
    "VuePropTypeChanged": "vue:prop:type:changed",
    "VueRequiredPropAdded": "vue:required:prop:added",
}
REMOVED_CODE = "api:removed"
