"""Rows that every operator must take."""

# null, empty, blank, very long, ties, repeated rows, a null id
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "one two three four five six"),
    (5, "word " * 30_000), (6, "x" * 50_000), (7, "é漢😀 a\u00a0b\r\nc\x0bd"), (8, "\n\n\n"),
]
