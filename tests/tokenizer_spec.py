"""A small tokenizer file for tests, in the layout with [STOP], [UNK] and [SPACE]."""

SPECIALS = ("[STOP]", "[UNK]", "[SPACE]")
ALPHABET = "abcdefghijklmnopqrstuvwxyz!'(),-./:;?"
#: Some common pairs, in the order in which they are merged.
MERGES = ("t h", "th e", "i n", "a n", "e r", "i s", "a l", "al l", "m e", "e l", "in g", "t i", "o n", "ti on")


def build_tokenizer_spec(alphabet: str = ALPHABET, merges=MERGES) -> dict:
    """Specials first, then single characters in sorted order, then one token per merge."""
    vocab = {t: i for i, t in enumerate(SPECIALS)}
    for c in sorted(set(alphabet)):
        vocab[c] = len(vocab)
    for m in merges:
        vocab.setdefault(m.replace(" ", ""), len(vocab))
    added = [{"id": i, "special": True, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False} for i, t in enumerate(SPECIALS)]
    return {"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": {"type": "Whitespace"},
            "post_processor": None, "decoder": None,
            "model": {"type": "BPE", "dropout": None, "unk_token": "[UNK]", "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "vocab": vocab, "merges": list(merges)}}
