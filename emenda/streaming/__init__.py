"""The column pipeline over unbounded inputs."""
