"""op9_packing's ids against the tokenizer file as it is."""

import zlib
from collections import defaultdict

import numpy as np

from auditmill.llm import packing, queries, stages

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n", "no token <|endoftext| >", "", "déjà <|endoftext|>" * 600]


def test_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    assert packing.splitting(packing.default_tokenizer())(TEXTS[0]) == [64, 220, 50256, 275]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for found in (queries.op9_packing(spark, str(tmp_path)), dict(stages.STAGES)["packing"](spark, docs, str(tmp_path))):
        got = defaultdict(list)
        for r in found.collect():
            got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        for d, text in enumerate(TEXTS):
            ids, at = [*tok.encode(text, add_special_tokens=False).ids, packing.END], 0
            for piece, (number, start, length, crc) in enumerate(sorted(got[d])):
                assert (number, start) == (piece, at)
                assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
                at += length
            assert at == len(ids)
