"""Types of the tables the engine works on, and their checks.

A document tree is a table of nodes, one row each. A node's place is `path`, the ordinals from the top
(empty for the top itself), so the parent is a slice of it and document order is the order of the arrays.
"""

from __future__ import annotations

from pyspark.sql import types as T

PROSE, CODE, DATA = BLOCK_TYPES = ("prose", "code", "data")
ROOT, CATEGORY, SECTION, OPERATION, ITEM = NODE_TYPES = ("root", "category", "section", "operation", "item")
#: The type of a single Markdown file's top node: not one of NODE_TYPES, so a search for sections passes it by.
FILE_TOP = "SECTION"
OPENREF, MARKDOWN, AUTO = FORMATS = ("openref", "markdown", "auto")

_S, _I = T.StringType(), T.IntegerType()
TEXT_MAP = T.MapType(_S, _S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BLOCK = _struct(type=_S, language=_S, content=_S, annotations=TEXT_MAP)
NODE = _struct(doc_key=_S, path=T.ArrayType(_I), type=_S, id=_S, title=_S, description=_S, content=T.ArrayType(BLOCK), metadata=TEXT_MAP)
EXAMPLE = _struct(id=_S, name=_S, code=_S, description=_S, dataSql=_S, response=_S, isSpotlight=T.BooleanType())
#: Parameters that a specification overrides have no fixed shape; they are kept as JSON.
OPENREF_OPERATION = _struct(id=_S, title=_S, description=_S, notes=_S, examples=T.ArrayType(EXAMPLE), overwriteParams=T.ArrayType(_S))
INFO = _struct(id=_S, title=_S, description=_S, specUrl=_S, slugPrefix=_S, libraries=T.ArrayType(TEXT_MAP))
SPEC = _struct(path=_S, info=INFO, operations=T.ArrayType(OPENREF_OPERATION), error=_S)

SPEC_SOURCE = _struct(url=_S, localPath=_S, format=_S)
OUTPUT = _struct(baseDir=_S, filenamePrefix=_S)
SDK_VERSION = _struct(displayName=_S, spec=SPEC_SOURCE, output=OUTPUT)
SDK = _struct(name=_S, language=_S, versions=T.MapType(_S, SDK_VERSION))
SDKS = _struct(sdks=T.MapType(_S, SDK))
CATEGORY_CONFIG = _struct(title=_S, description=_S, systemPrompt=_S, operations=T.ArrayType(_S), order=T.DoubleType())
CATEGORIES = _struct(categories=T.MapType(_S, CATEGORY_CONFIG))
REPORT = _struct(path=_S, valid=T.BooleanType(), severity=_S, message=_S, file=_S, line=_I, column=_I)
TOKEN = _struct(path=_S, pos=_I, type=_S, depth=_I, text=_S, raw=_S, lang=_S, section=_I, parent=_I, place=T.ArrayType(_I))
