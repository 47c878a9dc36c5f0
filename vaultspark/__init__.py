"""vaultspark: Data Vault loading and star-schema building on plain Apache Spark."""
