"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it, and it can be deleted as a whole.
"""
