"""Operations of a large-scale training-data pipeline; nothing else in memspark imports this subpackage."""
