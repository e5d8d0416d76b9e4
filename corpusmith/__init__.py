"""Spark jobs for improving labelled text corpora.

Tables of ``(ID, text, target)`` rows go in; isolated, augmented, relabelled,
split and scored tables come out. Every operator is a function from DataFrame
to DataFrame.
"""

from corpusmith.profiles import KOREAN, LATIN, TextProfile

__all__ = ["KOREAN", "LATIN", "TextProfile"]
