"""Readers of corpora, exams and run artefacts, and the sinks that publish them."""
