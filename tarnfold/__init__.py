"""tarnfold: set-based code and text retrieval analytics on PySpark.

Layers (each a plain ``DataFrame -> DataFrame`` library without global state):

* ``functions``  Column-expression library (tokens, diffs, logs, scalars, vectors)
* ``operators``  relational operators (chunking, ranking, recall, scoring, prompts)
* ``sources``    scans and sinks (repository trees, instance files, caches, reports)
* ``plans``      whole flows assembled from operators (search, recall sweep, prediction)
* ``streaming``  the incremental forms of chunking and of the embedding cache
* ``llm``        training-data operators; optional, nothing else imports it
"""
