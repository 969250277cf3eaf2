"""Operators for preparing training text: tokenising, packing, fingerprints,
licence and secret scans, language identification, language-model scores and
the near-duplicate family. Nothing outside this subpackage imports it."""
