"""Operations composed of operators: a repository of snapshots."""
