"""Character classes in Java regex syntax, equal to Python's \\w, \\s and \\d over Unicode, and word edges built from them."""

W = r"[\p{L}\p{N}_]"
S = r"[\s\x1c-\x1f\x85\p{Z}]"
D = r"\p{Nd}"
#: Not beside a word character; \b of Python is EDGE between a word character and another one.
NOT_AFTER_W = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_W = r"(?![\p{L}\p{N}_])"
EDGE = rf"(?:{NOT_AFTER_W}(?={W})|(?<={W}){NOT_BEFORE_W})"
