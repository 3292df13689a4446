"""Explicit schemas of the inputs."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


#: Headerless files of one revision, columns by position.
CODE_BLOCKS_FILE = _schema(("token_hash", _S), ("file_path", _S), ("start_line", _L), ("end_line", _L), ("method_name", _S), ("return_type", _S), ("parameters", _S), ("commit_hash", _S), ("token_sequence", _S))
CODE_BLOCKS_FILE_OLD = _schema(("block_id", _S), ("file_path", _S), ("start_line", _L), ("end_line", _L), ("method_name", _S), ("return_type", _S), ("parameters", _S), ("token_hash", _S), ("token_sequence", _S))
CLONE_PAIRS_FILE = _schema(("token_hash_1", _S), ("token_hash_2", _S), ("ngram_overlap", _D), ("verify_similarity", _D))
CLONE_PAIRS_FILE_OLD = _schema(("block_id_1", _S), ("block_id_2", _S), ("ngram_similarity", _D), ("lcs_similarity", _D))
DELETED_FILES = _schema(("commit_hash", _S), ("revision_id", _S), ("file_path", _S), ("commit_message", _S))
SAMPLES = _schema(("id", _S), ("function_name", _S), ("file_path", _S), ("is_deleted", _B), ("code", _S), ("loc", T.IntegerType()), ("similarity", _D), ("match_type", _S), ("clone_group_size", T.IntegerType()), ("clone_context", _S))

#: What a method is known by within a revision, and the columns carried for each side of a step.
SIGNATURE = ["file_path", "method_name", "return_type", "parameters"]
SIDE = ["revision_id", "token_hash", *SIGNATURE]
