"""Jobs composed of operators: lexicon and n-gram builds, correction, evaluation."""
