"""Fixed values of the corpus: classes, environments, extension sets, annotation classes."""

# Classes in configuration order, and those of the reduced profile.
CLASSES = (
    "common_rust",
    "fall_armyworm",
    "gray_leaf_spot",
    "healthy",
    "lethal_necrosis",
    "nitrogen_deficiency",
    "northern_corn_leaf_blight",
    "phosphorus_deficiency",
    "potassium_deficiency",
)
BASELINE_CLASSES = ("healthy", "common_rust", "fall_armyworm", "nitrogen_deficiency")
BASELINE_CAP = 500
# Classes that get the stronger augmentation.
MINORITY_CLASSES = ("potassium_deficiency", "nitrogen_deficiency", "phosphorus_deficiency", "gray_leaf_spot", "common_rust")
ENVIRONMENTS = ("lab", "real")
SEED = 42
# The three extension sets differ on purpose.
MANIFEST_EXTENSIONS = ("png", "jpg", "jpeg")
SUMMARY_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
EDA_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")
# Names of the annotation class ids 0 to 7.
ANNOTATION_CLASSES = (
    "fall_armyworm_damage",
    "healthy",
    "leaf_spot",
    "magnesium_deficiency",
    "nitrogen_deficiency",
    "northern_corn_leaf_blight",
    "phosphorus_deficiency",
    "potassium_deficiency",
)
# Channel means and deviations of the tensor normalisation.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def resolve_classes(given=None, profile=None, configured=CLASSES) -> tuple:
    """Allow-list by precedence: given on the call, else of the profile, else configured; an empty list falls through."""
    return tuple(given or profile or configured)
