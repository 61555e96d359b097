"""Training-data operators (packing, quality, dedup, decontamination, extraction, archives, URL filters).

Nothing else in the library imports this subpackage.
"""
