"""Corpusloom: DataFrame operators that prepare and evaluate language-model corpora."""
