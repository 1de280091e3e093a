"""Analytics over labelled text corpora, as DataFrame operators."""
