"""artifactlink: links the entities of two versions of a software artifact, or of any keyed tables with set-valued features."""
