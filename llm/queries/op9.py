import public_tokenizers

from llm.bpe_frame import encode_digests, tokenizer_text
from llm.texts import documents

TOKENIZER = "word_bpe_49k.json"


def bpe(spark, sf_dir):
    """Ids and decoded text of every document, as digests."""
    return encode_digests(documents(spark, sf_dir), tokenizer_text(public_tokenizers.path(TOKENIZER)))


QUERIES = {"op9_bpe": bpe}
