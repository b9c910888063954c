"""Large-scale training-data operators (dedup, filtering, mixing, tokenising, formatting).

Nothing outside this subpackage imports it.
"""
