"""tunelake: curating instruction-tuning data and following fine-tuning runs with Spark."""
