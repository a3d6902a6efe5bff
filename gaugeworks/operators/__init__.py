"""DataFrame operators on events, snapshots, devices, code registries, documents and search results."""
