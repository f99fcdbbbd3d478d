from llm.secret_scan import find_secrets
from llm.texts import documents


def secrets(spark, sf_dir):
    """Secrets of every document, in its text and in what it encodes."""
    return find_secrets(documents(spark, sf_dir))


QUERIES = {"op13_secret_scan": secrets}
