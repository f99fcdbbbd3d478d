import public_tokenizers

from llm.alignment import align
from llm.bpe_frame import tokenizer_text
from llm.texts import documents

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def alignment(spark, sf_dir):
    """Tokens, groups and links of every document, with corpus-wide counts of the linked ids."""
    with open(public_tokenizers.path(PIECES), "rb") as file:
        pieces = file.read()
    return align(documents(spark, sf_dir), tokenizer_text(public_tokenizers.path(BYTE_LEVEL)), pieces, public_tokenizers.PATTERN)


QUERIES = {"op11_alignment": alignment}
