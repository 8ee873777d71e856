"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it; the driver entry point adds its queries only
when it can be imported.
"""
