"""citeloom: citation and document-reception analytics as DataFrame programs."""
