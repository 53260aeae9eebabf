"""Where the default tokenizer is: a public one that is installed beside Spark. Its path is a parameter everywhere."""

from __future__ import annotations


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
