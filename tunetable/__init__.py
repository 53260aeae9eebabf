"""tunetable: DataFrame-in, DataFrame-out operators for the data side of model
fine-tuning and batch inference, on Spark.

Modules:

* ``sources``   manifests, corpora, object listings, tokenizer tables, tensor
  checkpoints and adapters, metric sinks;
* ``functions`` column functions: text, arrays (token and code sequences),
  lengths and schedules, BPE;
* ``operators`` length filters, clip pairing and candidates, batching and
  packing, tensor-table checks, decoding filters and ranking, codes and
  pooling, metrics, adapters, table forms of sequence operators;
* ``plans``     the two-level prefix scheme, checked broadcasts, lineage cuts,
  injector chains, batch scoring and the flagship report;
* ``streaming`` windowed latency on streams and row-local stream runs.

``registry`` holds the registered queries and their SQL twins;
``standins`` derives the tables they need from the driver tables.
"""

__version__ = "0.1.0"
