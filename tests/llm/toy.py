"""Toy languages: words from syllables of their own."""

SYLLABLES = {
    "en": ["th", "he", "ing", "ou", "ed", "wh", "and", "er"],
    "de": ["sch", "ung", "ei", "ß", "ü", "der", "ver", "ich"],
    "fr": ["eau", "é", "ou", "tion", "que", "è", "le", "oi"],
}


def speak(lang, rng, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))
