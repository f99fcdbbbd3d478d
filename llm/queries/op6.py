import public_tokenizers

from framevitals.sources.scratch import fresh_path
from llm.bit_planes import read_shards, write_shards
from llm.bpe_frame import tokenizer_text
from llm.texts import documents

TOKENIZER = "word_bpe_49k.json"


def bit_planes(spark, sf_dir):
    """Encode every document, write the shards, and read each document's place and checksum back."""
    folder = fresh_path(spark, "id-planes")
    manifest = write_shards(documents(spark, sf_dir), tokenizer_text(public_tokenizers.path(TOKENIZER)), folder)
    return read_shards(manifest, folder)


QUERIES = {"op6_bit_planes": bit_planes}
