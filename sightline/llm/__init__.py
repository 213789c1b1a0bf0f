"""Operators for preparing language-model training data, and the queries that apply them.

Nothing outside this folder imports it.  Modules: ``mixing``, ``ngram_join``, ``decontamination``,
``token_counts``, ``warc``, ``pii``, ``secret_scan``, ``topk``, ``toxicity``, ``url_filter``,
``hard_negatives``, ``token_files``, ``spelling``;
``hashing`` and ``common`` are shared helpers, ``queries`` registers one query per operator.
"""
