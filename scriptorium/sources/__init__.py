"""Readers of the archive's inputs."""
